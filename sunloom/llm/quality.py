"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Terms are a text's words, hashed, and how it is written: the shape of its words
(runs of upper and lower case letters, digits and each other sign), pairs of
neighbouring shapes, and how often words repeat. Both parts become tf-idf vectors
of their own length, the words weighing ``WORD_WEIGHT``; a singular value
decomposition of a bounded sample of labelled documents gives the latent space.
The sample's vectors are broadcast, every document's cosines with all of them
are computed in blocks, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sunloom.llm.common import byte_texts, remainder
from sunloom.llm.hashing import WordHasher

SHAPES, PAIRS, REPEATS, WORDS = 384, 512, 64, 1024
#: Terms of how a text is written, and all terms.
STYLE = SHAPES + PAIRS + REPEATS
TERMS = STYLE + WORDS
WORD_WEIGHT = 0.75
#: Labelled documents that the model holds at most, latent dimensions, and voters.
SAMPLE, DIMENSIONS, NEIGHBOURS = 4096, 32, 25
#: Exponent of the similarity that weighs a vote.
FOCUS = 8.0
THRESHOLD = 0.7
BATCH = 128

_CLASSES = bytes(
    ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c for c in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


class TermCounter:
    """Term counts of texts."""

    def __init__(self, most: int = 200_000) -> None:
        self.shapes: dict[bytes, int] = {}
        self.hasher, self.most = WordHasher(most), most

    def _shape(self, word: bytes) -> int:
        return xxhash.xxh32_intdigest(_RUN.sub(rb"\1", word.translate(_CLASSES))) % SHAPES

    def __call__(self, text: bytes) -> np.ndarray:
        out = np.zeros(TERMS, np.float32)
        words = text.split()
        if not words:
            return out
        known = self.shapes
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._shape(w)
        shapes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        out[:SHAPES] = np.bincount(shapes, minlength=SHAPES)
        if len(words) > 1:
            out[SHAPES : SHAPES + PAIRS] = np.bincount((shapes[:-1] * 193 + shapes[1:] * 389) % PAIRS, minlength=PAIRS)
        # Words that repeat: among neighbours, and pairs of words anywhere; each share as one of 16 terms.
        ids = self.hasher(words)
        n = len(ids)
        out[STYLE:] = np.bincount((ids % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
        pairs = ids[:-1] * np.uint64(3) + ids[1:] if n > 1 else ids[:0]
        shares = ((ids[1:] == ids[:-1]).mean() if n > 1 else 0.0, 1 - len(np.unique(pairs)) / max(len(pairs), 1), 1 - len(np.unique(ids)) / n, min(1.0, np.log2(n) / 16))
        for i, share in enumerate(shares):
            out[SHAPES + PAIRS + 16 * i + min(15, int(16 * share))] = max(1.0, n / 4) if i < 2 else 1.0
        return out


@dataclass(frozen=True)
class QualityModel:
    idf: np.ndarray
    #: TERMS x dimensions.
    axes: np.ndarray
    #: Unit latent vectors of the labelled documents, and their labels.
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighed(counts, self.idf) @ self.axes)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest, weighed by similarity; 0.5 if the model has no document."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosines = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-3) ** FOCUS
        return np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighed = np.log1p(counts) * idf
    return _unit(np.concatenate([_unit(weighed[:, :STYLE]), WORD_WEIGHT * _unit(weighed[:, STYLE:])], axis=1))


def fit(counts: np.ndarray, labels: np.ndarray) -> QualityModel:
    if not len(labels):
        return QualityModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.2).astype(np.float32)
    rows = _weighed(counts, idf)
    value, vector = np.linalg.eigh((rows.T @ rows).astype(np.float64))
    axes = vector[:, ::-1][:, : min(DIMENSIONS, len(rows))].astype(np.float32)
    return QualityModel(idf, axes, _unit(rows @ axes).astype(np.float32), labels.astype(np.float32))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of at most ``sample`` documents, those whose keys have the least hashes. A key with several texts gives one of them.

    A key with several labels has their majority (ties: 1); null labels don't count.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    picked = one.orderBy(F.xxhash64("__key"), "__key").limit(sample)
    # At most ``sample`` rows, so this side may be broadcast.
    joined = docs.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text")).join(F.broadcast(picked), "__key")
    # Of a key's texts that with the least hash, so that reruns agree.
    first = F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text")))["__text"].alias("__text")
    joined = joined.groupBy("__key", "__label").agg(first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter()
        for batch in batches:
            rows = [counter(t) for t in byte_texts(batch, "__text")]
            packed = [np.concatenate([(at := np.flatnonzero(r)).astype("f4"), r[at]]).astype("f4").tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("__key").cast(pa.string()), batch.column("__label"), pa.array(packed, pa.binary())], ["k", "y", "p"])

    found = joined.mapInArrow(count, "k string, y int, p binary").collect()
    found.sort(key=lambda r: (len(r["k"]), r["k"]))
    counts = np.zeros((len(found), TERMS), np.float32)
    for i, r in enumerate(found):
        at, value = np.frombuffer(r["p"], "f4").reshape(2, -1)
        counts[i, at.astype(np.int64)] = value
    return counts, np.array([r["y"] for r in found], np.float32)


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, score and predicted of every whole text; null and empty texts have no terms and are scored too."""
    names = list(keep or [])
    chosen = df.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("binary").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast((model.idf, model.axes, model.vectors, model.labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, counter = QualityModel(*shared.value), TermCounter()
        for batch in batches:
            texts, scores = list(byte_texts(batch, "__text")), []
            for start in range(0, len(texts), BATCH):
                scores.append(learned.vote(np.stack([counter(t) for t in texts[start : start + BATCH]])))
            score = np.concatenate(scores) if scores else np.empty(0)
            predicted = pa.array((score >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score.astype(np.float64)), predicted], [*names, "score", "predicted"])

    fields = [f for f in chosen.schema.fields if f.name != "__text"]
    return chosen.mapInArrow(run, StructType([*fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def held_out_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted; labels are learned only where crc32(key) modulo ``modulus`` is not ``held``.

    Labels of documents that don't exist teach nothing, and without labels every
    score is 0.5. Repeated rows are scored each; other columns are not read.
    """
    counts, marks = labelled_sample(docs, labels.where(remainder(key, modulus) != held), key, text, label)
    model = fit(counts, marks)
    marked = docs.select(F.col(key).alias("doc_id"), (remainder(key, modulus) == held).alias("held_out"), F.col(text).alias("text"))
    return score_quality(marked, model, keep=["doc_id", "held_out"])
