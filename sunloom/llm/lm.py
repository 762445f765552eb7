"""Interpolated modified Kneser-Ney language model over word n-grams.

Counting runs in Spark: tasks count the n-grams of their documents and deal them,
packed as hash arrays, to shards by context; a shard is merged at a time. Each
distinct n-gram counts once for the shorter one without its first word, which
gives the next lower order, down to words. Contexts so frequent that they would
fill a shard (at most ``8 * shards`` of each length, by their share of all
tokens) are spread over all shards by the following word.

The model is a set of sorted hash arrays in the shared folder, with arrays of
counts beside them. Consecutive shards share a file, so that the number of files
follows the cluster and not the corpus; each file has the shards' places in it,
and the model names every file with its length, so that one that is lost is an
error. Scoring tasks map the files into memory and look up the sorted hashes of a
block of texts, so that a worker holds only the pages which it touches. Nothing
is pruned, and counts are of 64 bits: one byte each, and the few that don't fit
beside them.

A model token is the XXH64 of a word with A-Z lowered, or ``END``. An n-gram is
``context * MIX + word`` modulo 2^64; as MIX is odd, the word can be recovered.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from sunloom.llm.common import byte_texts, cut, remainder, shared_folder
from sunloom.llm.hashing import WordHasher

END = np.uint64(0x9AE16A3B2F90404F)
#: What stands before a text's first word.
START = np.uint64(0xC949D7C7509E6557)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of an n-gram.
ORDER = 2
#: Bytes of text that make one model shard, the part that a task merges at a time.
SHARD_BYTES = 24 * 1024 * 1024
#: Contexts of a length that are spread at most, times 8: with more shards, the bound on their share stays here (8 MB).
MOST_HOT = 1 << 17
#: Files of each table for each slot of the cluster, and at least in all.
FILES_PER_SLOT, LEAST_FILES = 4, 1024
#: Tokens that a task counts at a time, and scores at a time.
COUNT_TOKENS, SCORE_TOKENS = 1 << 21, 1 << 19


def runs_of(values: np.ndarray) -> np.ndarray:
    """Start of every run of equal values."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = runs_of(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Which of ``shards`` equal ranges of the hash space a hash lies in: shards in order are the hashes in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def tokens_of(texts: Iterator[bytes], hasher: WordHasher) -> Iterator[np.ndarray]:
    """Each text's token hashes, the end included."""
    for text in texts:
        yield np.r_[hasher(text.lower().split()), END]


def blocks(texts: Iterator[bytes], order: int = ORDER, most: int = COUNT_TOKENS) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Tokens, the ``order - 1`` tokens before each one (the nearest first), and where texts start; a block of whole texts at a time."""
    hasher, held, size = WordHasher(), [], 0
    for t in tokens_of(texts, hasher):
        held.append(t)
        size += len(t)
        if size >= most:
            yield _joined(held, order)
            held, size = [], 0
    if held:
        yield _joined(held, order)


def _joined(held: list[np.ndarray], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    tokens, lengths = np.concatenate(held), np.array([len(t) for t in held])
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(tokens)) - np.repeat(starts, lengths)
    before = []
    for j in range(1, order):
        back = np.full(len(tokens), START)
        back[j:] = tokens[:-j]
        back[place < j] = START
        before.append(back)
    return tokens, before, starts


def gram_of(context: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return context * MIX + tokens


def context_of(before: list[np.ndarray], length: int) -> np.ndarray:
    """Hash of the ``length`` tokens before each one."""
    out = before[length - 1]
    for j in range(length - 2, -1, -1):
        out = gram_of(out, before[j])
    return out


def small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and in order those that are 255 or more."""
    low = np.minimum(counts, 255).astype("u1")
    return low, counts[low == 255].astype("u8")


def whole(low: np.ndarray, big: np.ndarray) -> np.ndarray:
    out = low.astype("u8")
    out[low == 255] = big
    return out


#: Arrays of a packed row at most.
WIDTH = 9
PACKED = "kind string, shard long, " + ", ".join(f"p{i} binary" for i in range(WIDTH))


def _batch(kind: str, shards: list[int], rows: list[list[np.ndarray]]) -> pa.RecordBatch:
    """One row per shard: a kind, the shard's number, and arrays as bytes."""
    width = len(rows[0]) if rows else 0
    columns = [pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(width)]
    columns += [pa.nulls(len(rows), pa.binary())] * (WIDTH - width)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), pa.array(shards, pa.int64()), *columns], ["kind", "shard", *(f"p{i}" for i in range(WIDTH))])


def _slices(shard: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each shard and its part of the arrays; the order within a shard is kept."""
    order = np.argsort(shard, kind="stable")
    at = runs_of(shard[order])
    for i, j in zip(at, np.r_[at[1:], len(shard)], strict=True):
        yield int(shard[order[i]]), [a[order[i:j]] for a in arrays]


def _values(row: pa.RecordBatch, i: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    return [np.frombuffer(row.column(f"p{j}")[i].as_buffer(), k) for j, k in enumerate(kinds)]


def _dealt(df: DataFrame, model: Layout) -> DataFrame:
    """Packed rows; each partition holds whole files, and of these the shards in order."""
    owner = F.expr(f"shard * {model.files} div {model.shards}")
    return df.repartition(model.files, owner).sortWithinPartitions("shard")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, pa.RecordBatch, int]]]]:
    """Rows of one shard together, each as its kind, batch and place."""
    now, held = None, []
    for batch in batches:
        for i, (kind, shard) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("shard").to_pylist(), strict=True)):
            if now is not None and shard != now:
                yield now, held
                held = []
            now = shard
            held.append((kind, batch, i))
    if held:
        yield now, held


@dataclass(frozen=True)
class Layout:
    """Where the model lies, in how many shards and files, and the contexts that are spread (by their length)."""

    folder: str
    shards: int
    files: int
    hot: tuple[np.ndarray, ...]

    def file_of(self, shard: np.ndarray | int) -> np.ndarray | int:
        return shard * self.files // self.shards

    def first_shard(self, file: int) -> int:
        return -(-file * self.shards // self.files)

    def gram_shard(self, length: int, context: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """An n-gram's shard: by its context, or by itself where the context is hot."""
        with np.errstate(over="ignore"):
            return shard_of(np.where(found_at(self.hot[length - 1], context)[1], grams, context * MIX), self.shards)


class SharedFolder:
    """Arrays below a folder that all executors share.

    A ``file:`` folder, or a plain path where the default file system is local,
    is mapped into memory where it lies. Of another store, PyArrow's file systems
    copy the array to the worker's own temporary folder first, and the copy is
    unlinked as soon as it is mapped.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    @property
    def _local(self) -> str | None:
        return "/" + self.folder.removeprefix("file:").lstrip("/") if self.folder.startswith("file:") else None

    def open(self, name: str) -> tuple[Any, Any]:
        """A stream to write, and what puts the finished file in its place: whole or not at all."""
        mark = f".{name}.{uuid.uuid4().hex}"
        if self._local is not None:
            Path(self._local).mkdir(parents=True, exist_ok=True)
            part = Path(self._local, mark)
            return part.open("wb"), lambda: os.replace(part, Path(self._local, name))
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.folder)
        return store.open_output_stream(f"{path}/{mark}"), lambda: store.move(f"{path}/{mark}", f"{path}/{name}")

    def read(self, name: str, kind: str, length: int) -> np.ndarray:
        """The array, which has to be there with its length."""
        if not length:
            return np.empty(0, kind)
        n_bytes = length * np.dtype(kind).itemsize
        if self._local is not None:
            path = Path(self._local, name)
            if not path.exists() or path.stat().st_size != n_bytes:
                raise FileNotFoundError(f"the model lacks {path} of {n_bytes} bytes")
            return np.memmap(path, kind, "r")
        import shutil
        import tempfile

        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.folder)
        if store.get_file_info(f"{path}/{name}").size != n_bytes:
            raise FileNotFoundError(f"the model lacks {path}/{name} of {n_bytes} bytes")
        with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(f"{path}/{name}") as source:
            shutil.copyfileobj(source, copy)
            copy.flush()
            return np.memmap(copy.name, kind, "r")


class TableWriter:
    """Writes a table's shards, which come in order, to its files; ``done`` are the files' lengths."""

    def __init__(self, layout: Layout, table: str, kinds: dict[str, str]) -> None:
        self.layout, self.table, self.kinds, self.shared = layout, table, kinds, SharedFolder(layout.folder)
        self.file: int | None = None
        self.done: list[tuple[str, int]] = []

    def add(self, shard: int, arrays: dict[str, np.ndarray]) -> None:
        file = self.layout.file_of(shard)
        if file != self.file:
            self.finish()
            self.file = file
            self.open = {n: self.shared.open(f"{self.table}.{file}.{n}") for n in self.kinds}
            self.size = dict.fromkeys(self.kinds, 0)
            self.first = self.layout.first_shard(file)
            self.at = np.zeros(self.layout.first_shard(file + 1) - self.first + 1, "u8")
        for name, kind in self.kinds.items():
            a = np.ascontiguousarray(arrays[name], kind)
            self.open[name][0].write(a.tobytes())
            self.size[name] += len(a)
        self.at[shard - self.first + 1 :] = self.size["key"]

    def finish(self) -> None:
        if self.file is None:
            return
        for name, (stream, place) in self.open.items():
            stream.close()
            place()
            self.done.append((f"{self.table}.{self.file}.{name}", self.size[name]))
        stream, place = self.shared.open(f"{self.table}.{self.file}.at")
        stream.write(self.at.tobytes())
        stream.close()
        place()
        self.done.append((f"{self.table}.{self.file}.at", len(self.at)))
        self.file = None


def found_at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted ``wanted`` stand in the sorted ``keys``, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass(frozen=True)
class KneserNey:
    """The model's layout and files, and its few global numbers."""

    layout: Layout
    #: Every file and how many elements it has.
    files: dict[str, int]
    order: int
    train_tokens: int
    vocabulary: int
    bigrams: int
    #: Discounts of counts 1, 2, 3 and more, of words' continuation counts first, then of n-grams by their length.
    discounts: tuple[tuple[float, float, float], ...]
    #: Probability mass that the words' discounts leave for an even spread.
    even: float

    @property
    def shards(self) -> int:
        return self.layout.shards


class Lookup:
    """The model as one worker sees it."""

    #: Arrays that stay mapped at a time.
    MOST_OPEN = 4_096

    def __init__(self, model: KneserNey) -> None:
        self.model, self.shared = model, SharedFolder(model.layout.folder)
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()

    def _array(self, name: str, kind: str) -> np.ndarray:
        if name not in self.open:
            # A table without a file for some shards has no n-gram there; a file that the model names must be there.
            self.open[name] = self.shared.read(name, kind, self.model.files.get(name, 0))
            if len(self.open) > self.MOST_OPEN:
                self.open.popitem(last=False)
        return self.open[name]

    def values(self, table: str, hashes: np.ndarray, kinds: dict[str, str], shard: np.ndarray | None = None) -> list[np.ndarray]:
        """Of each hash the named values, 0 where the table lacks it. ``shard``: where each lies, if not in its own range."""
        layout = self.model.layout
        order = np.argsort(hashes) if shard is None else np.lexsort((hashes, shard))
        at = runs_of(hashes[order])
        unique = hashes[order][at]
        shard = shard_of(unique, layout.shards) if shard is None else shard[order][at]
        out = [np.zeros(len(unique), "u8" if k == "u1" else k) for k in kinds.values()]
        edges = np.r_[runs_of(shard), len(shard)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            s = int(shard[i])
            file = layout.file_of(s)
            places = self._array(f"{table}.{file}.at", "u8")
            if not len(places):
                continue
            lo, hi = (int(places[s - layout.first_shard(file) + k]) for k in (0, 1))
            place, there = found_at(self._array(f"{table}.{file}.key", "u8")[lo:hi], unique[i:j])
            place = place[there] + lo
            for o, (name, kind) in zip(out, kinds.items(), strict=True):
                found = self._array(f"{table}.{file}.{name}", kind)[place]
                if kind == "u1":
                    found = found.astype("u8")
                    big = np.flatnonzero(found == 255)
                    if len(big):
                        where = np.searchsorted(self._array(f"{table}.{file}.{name}_big_at", "u8"), place[big])
                        found[big] = self._array(f"{table}.{file}.{name}_big", "u8")[where]
                o[i:j][there] = found
        back = np.empty(len(hashes), np.int64)
        back[order] = np.repeat(np.arange(len(unique)), np.diff(np.r_[at, len(hashes)]))
        return [o[back] for o in out]

    def score(self, tokens: np.ndarray, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each token's training count and log10 probability after its context."""
        m = self.model
        count, into = self.values("word", tokens, {"count": "u8", "into": "u8"})
        p = np.full(len(tokens), m.even / (m.vocabulary + 1))
        if m.bigrams:
            p += _discounted(into, m.discounts[0]) / m.bigrams
        for length in range(1, m.order):
            context = context_of(before, length)
            all_of, back = self.values(f"context{length}", context, {"all": "u8", "back": "f8"})
            grams = gram_of(context, tokens)
            (seen,) = self.values(f"gram{length}", grams, {"count": "u1"}, m.layout.gram_shard(length, context, grams))
            p = np.where(all_of > 0, _discounted(seen, m.discounts[length]) / np.maximum(all_of, 1) + back * p, p)
        return count, np.log10(p)


def _discounted(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)], 0.0)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2, 3 and more, from the numbers of entries with counts 1 to 4; 0.5, 1 and 1.5 if some are missing."""
    if min(n) == 0:
        return (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))  # type: ignore[return-value]


def _frequent_contexts(shards: int, order: int):
    """Of each block, its number of tokens (length 0) and the contexts with more than 1 / (8 * shards) of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, before, _ in blocks((t for b in batches for t in byte_texts(b, "text")), order):
            rows: list[tuple[int, int, int]] = [(0, 0, len(tokens))]
            for length in range(1, order):
                keys, counts = np.unique(context_of(before, length), return_counts=True)
                often = counts > len(tokens) // (8 * shards)
                rows += [(length, k, n) for k, n in zip(keys[often].view(np.int64).tolist(), counts[often].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["length", "w", "n"])

    return run


def hot_contexts(raw: DataFrame, shards: int, order: int = ORDER) -> tuple[np.ndarray, ...]:
    """By length, contexts among which is every one with at least 1 / (4 * shards) of all tokens; of a length at most 8 * shards.

    A block leaves out less than half of such a context's share, so what blocks
    report of it sums to 1 / (8 * shards) of all tokens or more.
    """
    reported = cut(raw.mapInArrow(_frequent_contexts(shards, order), "length long, w long, n long").groupBy("length", "w").agg(F.sum("n").alias("n")))
    total = reported.where("length = 0").agg(F.sum("n")).first()[0] or 0
    found = reported.where((F.col("length") > 0) & (F.col("n") >= total // (8 * shards))).select("length", "w").collect()
    return tuple(np.sort(np.array([r["w"] for r in found if r["length"] == length], np.int64).view(np.uint64)) for length in range(1, order))


def _packed_grams(layout: Layout, length: int, context: np.ndarray, leads: list[np.ndarray], grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Distinct n-grams by shard: contexts and how many n-grams each has, n-grams and counts, and the contexts' leading tokens."""
    shard = layout.gram_shard(length, context, grams)
    order = np.lexsort((context, shard))
    shard, context, grams, counts, leads = shard[order], context[order], grams[order], counts[order], [x[order] for x in leads]
    at = runs_of(shard)
    rows, numbers = [], []
    for i, j in zip(at, np.r_[at[1:], len(shard)], strict=True):
        runs = runs_of(context[i:j])
        numbers.append(int(shard[i]))
        rows.append([context[i:j][runs], *small(np.diff(np.r_[runs, j - i])), grams[i:j], *small(counts[i:j]), *[x[i:j][runs] for x in leads]])
    return _batch("gram", numbers, rows)


def _sums(layout: Layout, kind: str, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Values of distinct keys, by the keys' shards."""
    found = [(s, [k, *small(v)]) for s, (k, v) in _slices(shard_of(keys, layout.shards), keys, values)]
    return _batch(kind, [f[0] for f in found], [f[1] for f in found])


def _files(done: list[tuple[str, int]]) -> pa.RecordBatch:
    """Names and lengths of written files."""
    return _batch("file", [n for _, n in done], [[np.frombuffer(name.encode(), "u1")] for name, _ in done])


def _count_grams(layout: Layout, order: int):
    """Of each block the distinct n-grams, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, before, _ in blocks((t for b in batches for t in byte_texts(b, "text")), order):
            context = context_of(before, order - 1)
            grams = gram_of(context, tokens)
            del tokens
            place = np.argsort(grams)
            at = runs_of(grams[place])
            counts = np.diff(np.r_[at, len(place)])
            first = place[at]
            yield _packed_grams(layout, order - 1, context[first], [before[j][first] for j in range(order - 2, 0, -1)], grams[first], counts)

    return run


def _merge_grams(layout: Layout, length: int, order: int):
    """Writes n-grams with contexts of ``length`` tokens; gives the next lower order's, the contexts' counts, words' counts, and numbers."""
    oldest = np.uint64(pow(int(MIX), length - 1, 1 << 64))
    gram_kinds = ("u8", "u1", "u8", "u8", "u1", "u8", *["u8"] * (length - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = TableWriter(layout, f"gram{length}", {"key": "u8", "count": "u1", "count_big_at": "u8", "count_big": "u8"})
        for shard, rows in _by_shard(batches):
            parts = [_values(b, i, gram_kinds) for _, b, i in rows]
            each = [whole(p[1], p[2]).astype(np.int64) for p in parts]
            grams = np.concatenate([p[3] for p in parts])
            counts = np.concatenate([whole(p[4], p[5]) for p in parts])
            context, *leads = [np.concatenate([np.repeat(p[c], n) for p, n in zip(parts, each, strict=True)]) for c in (0, *range(6, 5 + length))]
            del parts
            place = np.argsort(grams, kind="stable")
            at = runs_of(grams[place])
            counts = np.add.reduceat(counts[place], at)
            place = place[at]
            grams, context, leads = grams[place], context[place], [x[place] for x in leads]
            low, big = small(counts)
            base = writer.size["key"] if writer.file == layout.file_of(shard) else 0
            writer.add(shard, {"key": grams, "count": low, "count_big": big, "count_big_at": np.flatnonzero(low == 255) + base})
            with np.errstate(over="ignore"):
                words = grams - context * MIX
            if length + 1 == order:
                # Words' own counts come from the longest n-grams.
                into, n = summed(words, counts)
                yield _sums(layout, "count", into, n)
            if length == 1:
                yield _sums(layout, "into", *summed(words, np.ones(len(words), "u8")))
            else:
                with np.errstate(over="ignore"):
                    shorter = context - leads[0] * oldest
                    suffix = shorter * MIX + words
                by = np.argsort(suffix)
                runs = runs_of(suffix[by])
                yield _packed_grams(layout, length - 1, shorter[by][runs], [x[by][runs] for x in leads[1:]], suffix[by][runs], np.diff(np.r_[runs, len(by)]))
            by = np.argsort(context)
            of_context, runs = counts[by], runs_of(context[by])
            keys = context[by][runs]
            stats = [np.add.reduceat(of_context, runs), *[np.add.reduceat(v, runs, dtype="u8") for v in (of_context == 1, of_context == 2, of_context > 2)]]
            found = [(s, [p[0], *[v for a in p[1:] for v in small(a)]]) for s, p in _slices(shard_of(keys, layout.shards), keys, *stats)]
            yield _batch(f"context{length}", [f[0] for f in found], [f[1] for f in found])
            numbers = np.array([*(int((counts == i).sum()) for i in (1, 2, 3, 4)), len(counts)], "u8")
            yield _batch("numbers", [0], [[numbers]])
        writer.finish()
        yield _files(writer.done)

    return run


def _total(width: int):
    """The sum of packed numbers, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for v in batch.column("p0"):
                total += np.frombuffer(v.as_buffer(), "u8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in total], [f"n{i}" for i in range(width)])

    return run


def _numbers(packed: DataFrame, width: int) -> list[int]:
    rows = packed.where("kind = 'numbers'").select("p0").mapInArrow(_total(width), ", ".join(f"n{i} long" for i in range(width)))
    return [x or 0 for x in rows.groupBy().sum().first()]


def _written(packed: DataFrame) -> dict[str, int]:
    return {bytes(r["p0"]).decode(): r["shard"] for r in packed.where("kind = 'file'").select("shard", "p0").collect()}


def _finish_shards(layout: Layout, by_length: dict[int, tuple[float, float, float]]):
    """Writes words and contexts; gives the files, and the numbers of words by continuation count, of words, and of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = TableWriter(layout, "word", {"key": "u8", "count": "u8", "into": "u8"})
        contexts = {k: TableWriter(layout, f"context{k}", {"key": "u8", "all": "u8", "back": "f8"}) for k in by_length}
        kinds = {"count": ("u8", "u1", "u8"), "into": ("u8", "u1", "u8"), **{f"context{k}": ("u8", *("u1", "u8") * 4) for k in by_length}}
        for shard, rows in _by_shard(batches):
            parts: dict[str, list[list[np.ndarray]]] = {k: [] for k in kinds}
            for kind, batch, i in rows:
                v = _values(batch, i, kinds[kind])
                parts[kind].append([v[0], *[whole(v[j], v[j + 1]) for j in range(1, len(v), 2)]])

            def column(kind: str, i: int) -> np.ndarray:
                return np.concatenate([p[i] for p in parts[kind]]) if parts[kind] else np.empty(0, "u8")

            for length, writer in contexts.items():
                if parts[f"context{length}"]:
                    sums = [summed(column(f"context{length}", 0), column(f"context{length}", i)) for i in (1, 2, 3, 4)]
                    back = sum(d * s[1] for d, s in zip(by_length[length], sums[1:], strict=True)) / sums[0][1]
                    writer.add(shard, {"key": sums[0][0], "all": sums[0][1], "back": back})
            if parts["count"]:
                # Every word ends some n-gram of every length, so both tables have the same words.
                keys, counts = summed(column("count", 0), column("count", 1))
                into = summed(column("into", 0), column("into", 1))[1]
                words.add(shard, {"key": keys, "count": counts, "into": into})
                numbers = [*(int((into == i).sum()) for i in (1, 2, 3, 4)), int((into > 2).sum()), len(keys), int(counts.sum())]
                yield _batch("numbers", [0], [[np.array(numbers, "u8")]])
        for writer in (words, *contexts.values()):
            writer.finish()
            yield _files(writer.done)

    return run


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as the session's Hadoop configuration takes it."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()


def train(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES, order: int = ORDER, files: int | None = None) -> KneserNey:
    """Count all of ``docs`` and write the model of ``order`` words (2 to 4).

    ``files`` bounds the files of a table (default: by the cluster's slots). Null
    texts count as empty; an empty text is one end token. No documents give a
    model that knows nothing, under which every token is equally likely.
    """
    if not 2 <= order <= 4:
        raise ValueError(f"order {order} isn't 2, 3 or 4")
    spark = docs.sparkSession
    raw = docs.select(F.col(text).cast("binary").alias("text"))
    shards = max(1, math.ceil((docs.select(F.sum(F.octet_length(text))).first()[0] or 0) / shard_bytes))
    most = max(LEAST_FILES, FILES_PER_SLOT * spark.sparkContext.defaultParallelism) if files is None else files
    hot = hot_contexts(raw, min(shards, MOST_HOT), order)
    layout = Layout(_qualified(spark, shared_folder(spark, "kneser-ney")), shards, min(shards, most), hot)

    packed, written, by_length, others, grams = raw.mapInArrow(_count_grams(layout, order), PACKED), {}, {}, None, 0
    for length in range(order - 1, 0, -1):
        merged = cut(_dealt(packed, layout).mapInArrow(_merge_grams(layout, length, order), PACKED))
        of = _numbers(merged, 5)
        by_length[length], grams = discounts(of[:4]), of[4]
        written |= _written(merged)
        rest = merged.where(~F.col("kind").isin("gram", "numbers", "file"))
        others = rest if others is None else others.unionByName(rest)
        packed = merged.where("kind = 'gram'")
    finished = cut(_dealt(others, layout).mapInArrow(_finish_shards(layout, by_length), PACKED))
    into = _numbers(finished, 7)
    written |= _written(finished)
    low = discounts(into[:4])
    even = (low[0] * into[0] + low[1] * into[1] + low[2] * into[4]) / grams if grams else 1.0
    return KneserNey(layout, written, order, into[6], into[5], grams, (low, *(by_length[k] for k in range(1, order))), even)


def score_texts(model: KneserNey, docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key, ``keep`` columns, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row.

    Null texts count as empty: one end token. Repeated rows are scored each.
    Columns that aren't in ``keep`` are not read. No rows give no rows. A model
    file that is lost fails the job.
    """
    chosen = docs.select(key, *(keep or []), F.col(text).cast("binary").alias("__text"))
    names = [key, *(keep or [])]
    added = [("n_tokens", LongType()), ("n_known", LongType()), ("train_tokens", LongType()), ("base_score", DoubleType()), ("score", DoubleType()), ("perplexity", DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for batch in batches:
            lengths, known, base, score = [], [], [], []
            for tokens, before, at in blocks(byte_texts(batch, "__text"), model.order, SCORE_TOKENS):
                count, log = lookup.score(tokens, before)
                lengths.append(np.diff(np.r_[at, len(tokens)]))
                known.append(np.add.reduceat((count > 0).astype(np.int64), at))
                base.append(np.add.reduceat(np.log10((count + 1.0) / (model.train_tokens + model.vocabulary + 1.0)), at))
                score.append(np.add.reduceat(log, at))
            if not lengths:
                continue
            n, k, b, s = (np.concatenate(x) for x in (lengths, known, base, score))
            out = [pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(np.full(len(n), model.train_tokens), pa.int64()), pa.array(b), pa.array(s), pa.array(10.0 ** np.minimum(-s / n, 300.0))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], [*names, *(n for n, _ in added)])

    return chosen.mapInArrow(run, StructType([*(chosen.schema[c] for c in names), *(StructField(n, t) for n, t in added)]))


def held_out_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2, order: int = ORDER) -> DataFrame:
    """Scores of all documents under a model of those whose crc32(key) modulo ``modulus`` is not ``held``."""
    marked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), (remainder(key, modulus) == held).alias("held_out"))
    model = train(marked.where(~F.col("held_out")), order=order)
    return score_texts(model, marked, keep=["held_out"])
