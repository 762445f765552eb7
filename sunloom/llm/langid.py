"""Language identification with a blended-spectrum string kernel.

A text is the set of its letter n-grams (orders 1 to 3, other characters as one
blank), hashed to ``BUCKETS``. The kernel of two texts is the number of shared
n-grams over the root of the product of their sizes. A Nystroem map over
landmark texts turns it into features; one-versus-rest kernel ridge regression
is fitted on them. As a text's kernel row is its presence row times the
landmarks, landmarks and ridge weights fold into one matrix, and scoring is a
matrix product for each batch of texts. With more languages than features the
two stay apart, so that the model grows by a few kilobytes for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sunloom.llm.common import cut, release_memory, remainder

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: The classifier is fitted on at most so many training texts of each language, and so many in all.
PER_LANGUAGE, IN_ALL = 512, 8192
#: Times as many texts as are wanted that the first bound on their hashes lets through.
REACH = 4.0
#: Landmark texts of each language at most, and in all; up to that many languages, each has one at least.
LANDMARKS, LANDMARKS_IN_ALL = 48, 1024
RIDGE = 1e-2
#: Turns ridge outputs into shares.
SHARPNESS = 6.0
UNKNOWN = "und"
BATCH = 64

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def presence(text: str, out: np.ndarray) -> bool:
    """Set ``out`` at the buckets of the text's n-grams; whether the text has a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[codes]
    if not letters.any():
        return False
    codes = np.where(letters, codes, np.uint32(32))
    first = np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]
    codes = codes[first].astype(np.uint64)
    gram = np.zeros(len(codes), np.uint64)
    for order in ORDERS:
        if len(codes) < order:
            break
        gram = gram[: len(codes) - order + 1] * np.uint64(0x110001) + codes[order - 1 :]
        mixed = (gram + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        out[(mixed >> np.uint64(49)).astype(np.int64)] = 1
    return True


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: Matrices whose product is BUCKETS x languages.
    weights: tuple[np.ndarray, ...]

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """Of presence rows the share of each language."""
        out = rows
        for w in self.weights:
            out = out @ w
        out = out / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        out = np.exp(SHARPNESS * (out - out.max(axis=1, keepdims=True)))
        return out / out.sum(axis=1, keepdims=True)


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    """Presence rows, packed or not, over the roots of their sizes."""
    full = np.unpackbits(rows, axis=1).astype(np.float32) if rows.dtype == np.uint8 else rows
    return full / np.sqrt(np.maximum(full.sum(axis=1, keepdims=True), 1))


def fit(rows: np.ndarray, languages: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """From presence rows and their languages. Rows packed to bits are unpacked a block at a time."""
    names = sorted(set(languages.tolist()))
    if not names:
        return LanguageModel([], (np.zeros((BUCKETS, 0), np.float32),))
    landmarks = min(landmarks, max(1, LANDMARKS_IN_ALL // len(names)))
    number = np.searchsorted(names, languages)
    order = np.argsort(number, kind="stable")
    ranked = np.empty(len(order), np.int64)
    ranked[order] = np.arange(len(order)) - np.searchsorted(number[order], number[order])
    chosen = order[ranked[order] < landmarks]
    if len(chosen) > LANDMARKS_IN_ALL:
        chosen = chosen[np.linspace(0, len(chosen) - 1, LANDMARKS_IN_ALL).astype(np.int64)]
    marks = _unit_rows(rows[chosen])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    features = np.concatenate([_unit_rows(rows[i : i + BATCH]) @ marks.T for i in range(0, len(rows), BATCH)]) @ root
    # Each language weighs the same, however many texts it gave.
    weighed = features / np.bincount(number)[number][:, None]
    # weighed.T @ (1 where a text is of the language, else -1), without that matrix of texts by languages.
    of_language = np.zeros((len(names), features.shape[1]))
    np.add.at(of_language, number, weighed)
    wanted = 2 * of_language.T - weighed.sum(axis=0)[:, None]
    solved = np.linalg.solve(weighed.T @ features + ridge * np.eye(features.shape[1]) / len(names), wanted)
    if len(names) <= len(chosen):
        return LanguageModel(names, ((marks.T @ (root @ solved).astype(np.float32)).astype(np.float32),))
    return LanguageModel(names, (marks.T.copy(), (root @ solved).astype(np.float32)))


def training_rows(df: DataFrame, text: str, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed presence rows of a bounded sample: of each language the texts with the least hashes.

    The driver sees one row per language, as the model does; more than ``IN_ALL``
    languages give one text each.
    """
    labelled = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    # Copies of a text are one text.
    distinct = cut(hashed.select("lang", "h").distinct())
    counts = {r["lang"]: r["count"] for r in distinct.groupBy("lang").count().collect()}
    if not counts:
        return np.zeros((0, BUCKETS // 8), np.uint8), np.empty(0, object)
    each = min(PER_LANGUAGE, max(1, IN_ALL // len(counts)))
    # First a bound on the hash, so that few are ranked; it is raised for a language that got fewer texts than it has.
    reach = dict.fromkeys(counts, REACH * each + 32)
    while True:
        bounds = df.sparkSession.createDataFrame([(name, min(1.0, reach[name] / n)) for name, n in counts.items()], "lang string, bound double")
        near = distinct.join(F.broadcast(bounds), "lang").where((F.col("h") / 2.0**64 + 0.5) <= F.col("bound"))
        least = cut(near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= each).select("lang", "h"))
        got = {r["lang"]: r["count"] for r in least.groupBy("lang").count().collect()}
        short = [name for name, n in counts.items() if got.get(name, 0) < min(each, n)]
        if not short:
            break
        for name in short:
            reach[name] *= 8
    ranked = hashed.join(F.broadcast(least), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for t in batch.column("text").to_pylist():
                presence(t, row := np.zeros(BUCKETS, np.uint8))
                packed.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(packed, pa.binary())], ["lang", "h", "bits"])

    found = sorted(ranked.select("text", "lang", "h").mapInArrow(pack, "lang string, h long, bits binary").collect(), key=lambda r: (r["lang"], r["h"], bytes(r["bits"])))
    rows = np.stack([np.frombuffer(r["bits"], np.uint8) for r in found]) if found else np.zeros((0, BUCKETS // 8), np.uint8)
    lettered = rows.any(axis=1) if len(rows) else np.zeros(0, bool)
    return rows[lettered], np.array([r["lang"] for r in found], object)[lettered]


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns, then the language and its score (named by ``out``), of every whole text.

    A null text, or one without a letter, gives ``und`` with score 0, as does a
    model that has learned no language. Other columns are not read. Repeated
    rows are scored each; no rows give no rows.
    """
    names = list(keep or [])
    # A text that is kept goes to the workers once.
    read = text if text in names else "__text"
    chosen = df.select(*[F.col(f"`{c}`") for c in names], *([] if text in names else [F.col(text).alias("__text")]))
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = LanguageModel(*shared.value)
        rows = np.zeros((BATCH, BUCKETS), np.float32)
        for batch in batches:
            texts, found, scores = batch.column(read), [], []
            for start in range(0, batch.num_rows, BATCH):
                part = texts.slice(start, BATCH)
                rows[:] = 0
                has = [bool(learned.languages) and t.is_valid and presence(t.as_py(), rows[i]) for i, t in enumerate(part)]
                if learned.languages:
                    shares = learned.shares(rows[: len(part)])
                    best = shares.argmax(axis=1)
                found += [learned.languages[best[i]] if h else UNKNOWN for i, h in enumerate(has)]
                scores += [float(shares[i, best[i]]) if h else 0.0 for i, h in enumerate(has)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, *out])
        del learned, rows
        release_memory()

    fields = [f for f in chosen.schema.fields if f.name != "__text"]
    return chosen.mapInArrow(run, StructType([*fields, StructField(out[0], StringType()), StructField(out[1], DoubleType())]))


def accepted(df: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``df``, with its columns, whose language is known with at least the score ``least``."""
    marked = identify(df, model, text, keep=df.columns, out=("__lang_pred", "__lang_score"))
    return marked.where((F.col("__lang_pred") != UNKNOWN) & (F.col("__lang_score") >= least)).select(*[F.col(f"`{c}`") for c in df.columns])


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    return fit(*training_rows(df, text, lang))


def held_out_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from documents whose crc32(key) modulo ``modulus`` is not ``held``."""
    model = learn(docs.where(remainder(key, modulus) != held), text, lang)
    marked = docs.select(F.col(key).alias("doc_id"), (remainder(key, modulus) == held).alias("held_out"), F.col(text).alias("text"))
    return identify(marked, model, keep=["doc_id", "held_out"])
