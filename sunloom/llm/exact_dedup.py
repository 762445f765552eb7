"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

Every normalised text is cut into chunks whose ends depend on nearby content
alone. A chunk's identifier is a pair of 64-bit hashes. One pass over the
distinct chunks *verifies* that no identifier stands for two chunk texts (it
reseeds and starts again if one does). From then on a document is its recipe,
the ordered list of chunk identifiers: equal recipes mean equal texts, and the
grouping moves 16 bytes for each chunk instead of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import SPACE_CLASS, cut, empty_text, keep_rows, with_group

# Letters of other scripts that may end a chunk, at a word's end or anywhere.
_WORD_ENDS = r"\u03B1-\u03B8\u03C2\u0430-\u0437\u044B-\u0451\u05D0-\u05D5\u0627-\u062D\u0905-\u0914\u0E01-\u0E0F"
_ANYWHERE = r"\u3002\uFF0C\u3041-\u304A\u30A1-\u30AA\u4E00-\u4EFF\uAC00-\uADFF"
#: A chunk has 256 to 1024 characters and ends after a rare letter pair, else at 1024.
CHUNK_PATTERN = r"(?s).{256,1022}?[aeinorst][dghklmpuy](?=[ \p{Punct}])|.{1,1024}"
#: The same for texts in other scripts, told by their bytes for each character, where some letters end a chunk too.
WIDE_PATTERN = rf"(?s).{{256,1022}}?(?:(?:[aeinorst][dghklmpuy]|[{_WORD_ENDS}])(?=[ \p{{Punct}}])|[{_ANYWHERE}])|.{{1,1024}}"
BYTES_BEYOND_LATIN = 1.25


def normalise(text: str | Column) -> Column:
    return F.regexp_replace(empty_text(text), SPACE_CLASS, " ")


def chunks_of(text: Column, pattern: str | None = None) -> Column:
    """The text's chunks by ``pattern``, or by that of its script: equal texts have equal chunks."""
    if pattern:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    other = F.octet_length(text) > F.lit(BYTES_BEYOND_LATIN) * F.length(text)
    return F.when(other, chunks_of(text, WIDE_PATTERN)).otherwise(chunks_of(text, CHUNK_PATTERN))


def identifier(chunk: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), chunk).alias("a"), F.xxhash64(chunk, F.lit(~seed)).alias("b"))


def ambiguous_identifiers(texts: DataFrame, column: str, seed: int, pattern: str | None = None) -> DataFrame:
    """Identifiers that two different chunk texts share.

    The distinct of (identifier, chunk) combines copies before the shuffle, so a
    passage of a third of all documents costs no more than a rare one.
    """
    chunk = texts.select(F.explode(chunks_of(F.col(column), pattern)).alias("chunk"))
    distinct = chunk.select(identifier(F.col("chunk"), seed).alias("id"), "chunk").distinct()
    return distinct.groupBy("id").count().where("count > 1")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", pattern: str | None = None, attempts: int = 4) -> DataFrame:
    """One row per row of ``df``: key, keep_id, group_size, kept and text_sha256.

    Null texts count as empty, and empty texts form one group. Texts are equal
    when equal after each run of white space is one space. The smallest key of a
    group stays; null keys stay only in groups that have no other key. Rows that
    repeat the smallest key are all marked kept, since the key names the
    document; ``exact_dedup`` leaves one of them. Other columns of ``df`` are
    not read, so their names can't clash. An empty table gives an empty result.
    """
    plain = df.select(F.col(key).alias("doc_id"), normalise(F.col(text)).alias("norm"))
    for seed in range(attempts):
        if ambiguous_identifiers(plain, "norm", seed, pattern).isEmpty():
            break
    else:
        raise RuntimeError(f"chunk identifiers are ambiguous under {attempts} seeds")
    recipes = cut(
        plain.select(
            "doc_id",
            F.transform(chunks_of(F.col("norm"), pattern), lambda c: identifier(c, seed)).alias("recipe"),
            F.sha2(F.col("norm"), 256).alias("text_sha256"),
        )
    )
    # Documents find their group by 32 bytes instead of the recipe, which grows with the text: equal recipes are equal texts.
    groups = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    repeated = cut(groups.where("group_size > 1").drop("recipe"))
    return with_group(recipes.drop("recipe"), repeated, "text_sha256", "group_size", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one for each distinct text, with all their columns; keys may be null or repeat."""
    kept = exact_groups(df, key, text).where("kept").select(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text_sha256").alias("text")).alias("place"))
    place = F.struct(F.col(key).isNull().alias("none"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.sha2(normalise(F.col(text)), 256).alias("text"))
    return keep_rows(df, place, kept.distinct())
