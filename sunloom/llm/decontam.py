"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so that a question with
other figures or people has the template of the original; gendered pronouns
become one word each, as they change with the names. Windows of five template
tokens are hash-joined between documents and benchmark items. Items that differ
in their placeholders' values alone are one class, so a benchmark made from one
template doesn't multiply the join.

The placeholders' values must agree: within one alignment each value of the item
stands for one value of the document, and no two names for the same. Windows
with a value that disagrees don't count. A document is contaminated if windows
that agree cover 0.8 or more of an item's windows.

A capitalised word that opens a sentence may be a name or not, and both readings
are tried, on both sides. They never take away what windows without them agree
on. Only windows with two literal words under either reading count; an item that
has none is matched exactly.

Documents' windows first pass a bitmap of fixed size, set by the benchmark's
window hashes. It has no false negatives; it only keeps windows from the join
which cannot be in the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sunloom.llm.common import byte_texts, cut, release_memory, text_id, without

WINDOW, SHARE = 5, 0.8
#: Bits of the bitmap, by two probes.
BITMAP_BITS = 24
#: Benchmark windows that are broadcast at most (about 10 MB); more are joined by a shuffle.
BROADCAST_WINDOWS = 100_000
#: Lanes over which documents are spread where the benchmark is joined by a shuffle.
LANES = 8
#: Literal tokens that a window needs; an item without such a window is matched exactly.
LITERALS = 2

# Units of measure that may follow a number.
UNITS = frozenset(
    b"mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ton tons tonne tonnes ml cl l liter liters litre litres "
    b"s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    b"mph kph kmh hz khz mhz ghz w kw mw v kv a j kj cal kcal b kb mb gb tb bit bits byte bytes percent pct "
    b"usd eur gbp jpy dollar dollars cent cents euro euros pound pounds yen degree degrees".split()
)
# Words that are capitalised only for where they stand, and are never names.
FUNCTION = frozenset(
    b"a an the this that these those what who whom whose which when where why how is are was were am be been do does did has have had can could "
    b"should would shall must might i you he she it we they his her its our their your my me him them us and or but nor so yet if then than because "
    b"while although though unless until since after before during in on at by for from of to with without into onto over under between among about "
    b"as not no yes there here each every all both some any many much few more most one two three".split()
)
# Numbers in words.
NUMBER_WORDS = frozenset(
    b"two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    b"twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
# Pronouns that follow a name's gender, and the word that stands for each.
PRONOUNS = {b"she": b"he", b"her": b"his", b"him": b"his", b"hers": b"his", b"herself": b"himself"}
_EDGE = b" \t\n\r\f\v!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~-"
_NUMBER = re.compile(rb"[+-]?\d[\d.,:/]*")
_ENDS = (b".", b"!", b"?")

LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: Sets hashes of exact windows apart from those of templates.
_EXACT = np.uint64(0x510E527FADE682D1)
_KIND_HASH = np.array([0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B], np.uint64)


def _hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token)


def _capitalised(core: bytes) -> bool:
    """Whether a word begins with a capital and has small letters."""
    if len(core) < 2 or core[0] < 65 or 90 < core[0] < 0xC3:
        return False
    if core[0] <= 90:
        return core.upper() != core
    word = core.decode("utf-8", "replace")
    return word[0].isupper() and not word.isupper()


def _parts(word: bytes) -> list[tuple[int, int, bool]]:
    """(kind, hash, could be a name) of a word's tokens, seen alone; UNIT here means: if it follows a number."""
    core = word.strip(_EDGE)
    if not core:
        return []
    if core[0] <= 57 and (number := _NUMBER.match(core)):
        value, rest = number[0].rstrip(b".,:/"), core[number.end() :]
        if not rest:
            return [(NUMBER, _hash(value), False)]
        if rest.lower() in UNITS:
            return [(NUMBER, _hash(value), False), (UNIT, _hash(rest.lower()), False)]
    low = core.lower()
    if low in NUMBER_WORDS:
        return [(NUMBER, _hash(low), False)]
    # Of letters beyond ASCII the case is left as it is, on both sides alike.
    return [(UNIT if low in UNITS else LITERAL, _hash(PRONOUNS.get(low, low)), low not in FUNCTION and _capitalised(core))]


class Columns:
    """Arrays that grow at their ends."""

    def __init__(self, *kinds: str) -> None:
        self.arrays, self.size = [np.zeros(1024, k) for k in kinds], 0

    def extend(self, *columns: list) -> None:
        end = self.size + len(columns[0])
        if end > len(self.arrays[0]):
            self.arrays = [np.concatenate([a, np.zeros(max(end, len(a)), a.dtype)]) for a in self.arrays]
        for a, c in zip(self.arrays, columns, strict=True):
            a[self.size : end] = c
        self.size = end


class Canonicaliser:
    """Texts as arrays of template hashes, kinds and value hashes. Words are remembered up to a fixed number."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        #: Of each word: its first token, how many it has, whether it ends a sentence. Of each token: kind, value, could be a name.
        self.words = Columns("i8", "i8", "?")
        self.tokens = Columns("i8", "u8", "?")

    def _learn(self, words: list[bytes]) -> None:
        parts = [_parts(w) for w in words]
        many = [len(p) for p in parts]
        first = (np.cumsum([0, *many[:-1]]) + self.tokens.size).tolist()
        for i, w in enumerate(words, len(self.known)):
            self.known[w] = i
        self.words.extend(first, many, [w.rstrip(b"\"')]").endswith(_ENDS) for w in words])
        flat = [t for p in parts for t in p]
        self.tokens.extend([t[0] for t in flat], np.array([t[1] for t in flat], np.uint64), [t[2] for t in flat])

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.read(text)[:3]

    def read(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template, kinds, values, and which literals may be names as well."""
        words = text.split()
        if len(self.known) > self.most:
            self._clear()
        if new := [w for w in dict.fromkeys(words) if w not in self.known]:
            self._learn(new)
        first, many, ends = self.words.arrays
        kinds, values, names = self.tokens.arrays
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n = many[ids]
        opens = np.ones(len(ids), bool)
        opens[1:] = ends[ids[:-1]]
        at = first[ids]
        if (n != 1).any():
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, opens = np.repeat(at, n) + within, np.repeat(opens, n)
        kind, value = kinds[at], values[at]
        lone = kind == UNIT
        lone[1:] &= kind[:-1] != NUMBER
        kind[lone] = LITERAL
        name = (kind == LITERAL) & names[at]
        kind[name & ~opens] = NAME
        placed = np.flatnonzero(kind)
        template = value.copy()
        template[placed] = _KIND_HASH[kind[placed]]
        return template, kind, value, name & opens


def window_hashes(template: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` template tokens; the width is part of it."""
    n = len(template) - width + 1
    if n < 1 or width < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ template[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def other_readings(template: np.ndarray, either: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, offsets read as names (bits) and hash of each further reading of windows with words that may be names."""
    n = len(template) - width + 1
    if n < 1 or width < 1 or not either.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    pattern = np.zeros(n, np.int64)
    for i in range(width):
        pattern |= either[i : i + n].astype(np.int64) << i
    at = np.flatnonzero(pattern)
    bits = pattern[at]
    several = np.flatnonzero(bits & (bits - 1))
    if len(several):  # the readings between all words as names and none
        more = [(at[i], mask) for i in several.tolist() for mask in range(1, int(bits[i])) if mask & ~int(bits[i]) == 0]
        at = np.concatenate([at, [a for a, _ in more]])
        bits = np.concatenate([bits, [m for _, m in more]])
    out = np.full(len(at), width, np.uint64)
    for i in range(width):
        token = np.where((bits >> i) & 1 == 1, _KIND_HASH[NAME], template[at + i])
        out = (out ^ token) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return at, bits, out


def _probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - BITMAP_BITS)
    return (hashes >> shift).astype(np.int64), ((hashes << np.uint64(BITMAP_BITS)) >> shift).astype(np.int64)


def _slots(kind: np.ndarray, value: np.ndarray, at: int, width: int, bits: int = 0) -> list[int]:
    """Values of a window's placeholders, in order; ``bits`` are offsets read as names."""
    inside = slice(at, at + width)
    placed = kind[inside] != LITERAL
    if bits:
        placed = placed | ((bits >> np.arange(width)) & 1 == 1)
    return value[inside][placed].view(np.int64).tolist()


#: ``other``: not the first reading, or exact. Exact windows have no slots.
_WINDOWS = "array<struct<h:bigint,pos:int,slots:array<bigint>,other:boolean>>"
_WINDOW_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.int64())), ("other", pa.bool_())]))
_UNIT_HASHES = frozenset(map(_hash, UNITS))


def _numbered(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Each placeholder's value as its rank by first place, doubled, and one more for a number."""
    seen: dict[tuple[bool, int], int] = {}
    out = np.zeros(len(kind), np.uint64)
    for i in np.flatnonzero(kind != LITERAL).tolist():
        number = bool(kind[i] == NUMBER)
        out[i] = 2 * seen.setdefault((number, int(value[i])), len(seen)) + number
    return out


def _item_windows(text: bytes, canonical: Canonicaliser) -> tuple[int, int, int, list[dict]]:
    """Class, width, how many windows count, and every reading of these.

    Slots are numbered by their first place, so items that differ in their
    placeholders' values alone have one class and the same slots.
    """
    template, kind, value, either = canonical.read(text)
    width = min(WINDOW, len(template))
    if not width:
        return 0, 0, 0, []
    all_named = np.where(either, NAME, kind)
    least = min(LITERALS, width)
    used = set(np.flatnonzero(np.convolve(all_named == LITERAL, np.ones(width, int), "valid") >= least).tolist())
    exact = window_hashes(value ^ _EXACT, width).view(np.int64)
    if not used:
        windows = [{"h": h, "pos": i, "slots": [], "other": True} for i, h in enumerate(exact.tolist())]
        return _signed(xxhash.xxh64_intdigest(value.tobytes(), 1)), width, len(windows), windows
    slot = _numbered(all_named, value)
    first = window_hashes(template, width).view(np.int64)
    windows = [{"h": int(first[i]), "pos": i, "slots": _slots(kind, slot, i, width), "other": False} for i in sorted(used)]
    at, bits, hashes = other_readings(template, either, width)
    for i, b, h in zip(at.tolist(), bits.tolist(), hashes.view(np.int64).tolist(), strict=True):
        if i in used:
            windows.append({"h": h, "pos": i, "slots": _slots(kind, slot, i, width, b), "other": True})
    if 0 in used and int(value[0]) in _UNIT_HASHES:  # a unit or not, by what stands before the item
        windows.append({"h": int(exact[0]), "pos": 0, "slots": [], "other": True})
    known = np.where(either, _KIND_HASH[NAME], template).tobytes() + slot.tobytes()
    return _signed(xxhash.xxh64_intdigest(known)), width, len(used), windows


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _benchmark(items: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Classes of items (entry, item, n_items, width, n) and their windows (entry, h, pos, slots, other); items without a token have none."""
    chosen = items.where(F.col(text).isNotNull()).select(F.col(key).alias("item"), F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonicaliser()
        for batch in batches:
            made = [_item_windows(t, canonical) for t in byte_texts(batch, "__text")]
            numbers = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("item"), *numbers, pa.array([m[3] for m in made], _WINDOW_TYPE)], ["item", "entry", "width", "n", "windows"])

    listed = cut(chosen.mapInArrow(run, StructType([chosen.schema["item"], *_fields("entry long, width int, n int, windows " + _WINDOWS)])).where("n > 0"))
    # A repeated item is one.
    single = listed.select("item", "entry", "width", "n").distinct()
    classes = single.groupBy("entry").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("n_items"), F.min("width").alias("width"), F.min("n").alias("n"))
    return classes, listed.select("entry", F.inline("windows")).distinct()


def _fields(ddl: str) -> list[StructField]:
    from pyspark.sql.types import _parse_datatype_string

    return list(_parse_datatype_string(ddl).fields)


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The packed bitmap (2 MB, whatever the benchmark's size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITMAP_BITS, bool)
        for batch in batches:
            for probe in _probes(batch.column("h").to_numpy().view(np.uint64)):
                bits[probe] = True
        packed = np.packbits(bits)
        words = packed.view("u8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["at", "word"])

    words = windows.select("h").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).collect()
    packed = np.zeros((1 << BITMAP_BITS) // 64, np.uint64)
    packed[[r["at"] for r in words]] = np.array([r["word"] for r in words], np.int64).view(np.uint64)
    return packed


def _candidates(docs: DataFrame, text: str, bitmap: np.ndarray, widths: list[int], exact: bool, keep: list[str]) -> DataFrame:
    """Every document with those of its windows that pass the bitmap; exact windows only if some item has one."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    chosen = docs.select(*keep, F.col(text).cast("binary").alias("__text"))

    def found(text: bytes, bits: np.ndarray, canonical: Canonicaliser) -> list[dict]:
        template, kind, value, either = canonical.read(text)
        own: list[dict] = []
        for width in widths:
            first = window_hashes(template, width)
            at, names, others = other_readings(template, either, width)
            same = window_hashes(value ^ _EXACT, width) if exact else first[:0]
            hashes = np.concatenate([first, others, same])
            one, two = _probes(hashes)
            n, m = len(first), len(first) + len(others)
            passing = np.flatnonzero(bits[one])
            for i in passing[bits[two[passing]]].tolist():
                h = int(hashes[i].view(np.int64))
                if i < n:
                    own.append({"h": h, "pos": i, "slots": _slots(kind, value, i, width), "other": False})
                elif i < m:
                    p = int(at[i - n])
                    own.append({"h": h, "pos": p, "slots": _slots(kind, value, p, width, int(names[i - n])), "other": True})
                else:
                    own.append({"h": h, "pos": i - m, "slots": [], "other": True})
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, canonical = np.unpackbits(shared.value.view(np.uint8)).view(bool), Canonicaliser()
        for batch in batches:
            made = [found(t, bits, canonical) for t in byte_texts(batch, "__text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, _WINDOW_TYPE)], [*keep, "windows"])
        del bits, canonical
        release_memory()

    return chosen.mapInArrow(run, StructType([*(chosen.schema[c] for c in keep), *_fields("windows " + _WINDOWS)]))


def _agreeing(windows: str) -> Column:
    """Positions of those of an alignment's windows (pos, pairs) whose slots agree with all others'.

    A one-element array binds a value that a lambda uses, so it is computed once.
    """
    pairs = f"array(array_distinct(flatten(transform({windows}, w -> w.pairs))))"
    # A value of the item that stands for two of the document, or a name of the document that stands for two of the item (names are even).
    clashing = "filter(ps, p -> exists(ps, q -> (q.a = p.a AND q.b <> p.b) OR (q.b = p.b AND q.a <> p.a AND q.a % 2 = 0 AND p.a % 2 = 0)))"
    kept = f"transform(filter({windows}, w -> NOT arrays_overlap(w.pairs, bad)), w -> w.pos)"
    return F.expr(f"flatten(flatten(transform({pairs}, ps -> transform(array({clashing}), bad -> {kept}))))")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """doc_id, contaminated, n_items, best_item and best_share for every row of ``docs``.

    ``best_share`` is the largest share of an item's windows that the document
    holds with consistent slots (0 if none); ``best_item`` the item that has it
    (ties: the smallest key), among items at or above ``share``, else null. Items
    that differ in their placeholders' values alone are found together. Items of
    fewer than five tokens are one window of all their tokens; null and empty
    items, and null and empty texts, match nothing. Repeated documents are judged
    each. Other columns are not read. No documents give no rows.
    """
    classes, windows = (cut(x) for x in _benchmark(benchmark, item, item_text))
    widths = [r["width"] for r in classes.select("width").distinct().collect()]  # at most five
    exact = not windows.where(F.col("other") & (F.size("slots") == 0)).isEmpty()
    renamed = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = cut(_candidates(renamed, "text", _bitmap(windows), widths, exact, ["doc_id"])).withColumn("rid", F.monotonically_increasing_id())
    held = rows.where(F.size("windows") > 0).select("rid", F.inline("windows")).withColumnsRenamed({"pos": "at", "slots": "doc_slots", "other": "doc_other"})
    if windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        joined = held.join(F.broadcast(windows), "h")
    else:
        # A window that a third of all documents hold is one key: documents are dealt to lanes, and windows go to each.
        spread = windows.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))))
        joined = held.withColumn("lane", F.pmod("rid", F.lit(LANES))).join(spread, ["h", "lane"])
    joined = joined.where(F.size("slots") == F.size("doc_slots"))
    pairs = F.zip_with("slots", "doc_slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    window = F.struct("pos", pairs.alias("pairs"))
    first = ~(F.col("other") | F.col("doc_other"))
    aligned = joined.groupBy("rid", "entry", (F.col("at") - F.col("pos")).alias("shift")).agg(F.collect_set(window).alias("all"), F.collect_set(F.when(first, window)).alias("firsts"))
    agreeing = aligned.select("rid", "entry", F.explode(F.array_union(_agreeing("all"), _agreeing("firsts"))).alias("pos"))
    covered = agreeing.groupBy("rid", "entry").agg(F.count_distinct("pos").alias("held"))
    shares = covered.join(classes, "entry").select("rid", "item", "n_items", (F.col("held") / F.col("n")).alias("share"))
    best = shares.groupBy("rid").agg(
        F.coalesce(F.sum(F.when(F.col("share") >= share, F.col("n_items"))), F.lit(0)).alias("n_items"),
        F.max("share").alias("best_share"),
        F.min(F.struct((-F.col("share")).alias("s"), F.col("item").alias("item")))["item"].alias("best_item"),
    )
    return rows.select("rid", "doc_id").join(best, "rid", "left").select(
        "doc_id",
        F.coalesce(F.col("n_items") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.when(F.col("n_items") > 0, F.col("best_item")).alias("best_item"),
        F.coalesce("best_share", F.lit(0.0)).alias("best_share"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item. Each is judged by its own text, so keys may be null or repeat."""
    judged = docs.select(text_id(text).alias("id"), F.col(text).alias("text"))
    bad = contamination(judged, benchmark, "id").where("contaminated").select(F.col("doc_id").alias("__bad_text")).distinct()
    return without(docs, bad, text_id(docs[text]) == F.col("__bad_text"))
