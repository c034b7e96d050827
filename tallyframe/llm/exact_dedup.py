"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, each chunk gets a short name and a
SHA-256 digest, and a document becomes the ordered list of its chunks' names.
Chunks are deduplicated to verified identifiers: a name that stands for more
than one digest anywhere is no identifier, and the documents that hold it are
compared by their digests instead. Lists, not texts, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import small

#: At least 384 characters, then on to the next "e " or "a ", or a mark that texts without spaces have (base64, hex,
#: East Asian punctuation and syllables); 4096 where there is none.
CHUNK = r"(?s).{384,4096}?(?<=[ea] |[+/\u3001\u3002\uFF0C\u306E\u7684]|00|ff)|.{1,4096}"


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def recipes(docs: DataFrame, id_col: str, text_col: str, name_bits: int) -> DataFrame:
    """row, doc_id, text_sha256, names and digests of the chunks in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col).cast("string")).alias("norm"))
    chunked = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"),
    )
    name = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - name_bits) if name_bits < 64 else F.xxhash64(c)
    return chunked.select(
        "row",
        "doc_id",
        "text_sha256",
        F.transform("chunks", name).alias("names"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c.cast("binary"), 256))).alias("digests"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest id stays; of rows that also
    share the id, one. A null text equals an empty one; a null id comes before all
    others. An empty table gives no rows; other columns are not read.
    ``name_bits`` shortens the names, to show that results don't rest on them.
    """
    rows = stored(recipes(docs, id_col, text_col, name_bits), "recipes")
    chunks = rows.select(F.explode(F.arrays_zip("names", "digests")).alias("c")).select("c.names", "c.digests").distinct()
    shared = chunks.groupBy("names").count().filter("count > 1").select(F.col("names").alias("name"))
    unsure = rows.select("row", F.explode("names").alias("name")).join(shared, "name", "left_semi").select("row").distinct().withColumn("unsure", F.lit(True))
    keyed = rows.join(unsure, "row", "left").select(
        "row",
        "doc_id",
        "text_sha256",
        F.col("names").alias("key"),
        F.when(F.col("unsure"), F.col("digests")).otherwise(F.array().cast("array<binary>")).alias("exact"),
    )
    groups = keyed.groupBy("key", "exact").agg(
        F.min(F.struct("doc_id", "row")).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )
    groups = stored(groups.filter("group_size > 1").select("key", "exact", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "groups")
    alone = F.col("group_size").isNull()
    return keyed.join(small(groups), ["key", "exact"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts.

    Rows are told apart by id and text digest, so another text under the id of a
    copy stays; of rows equal in both, any one stays.
    """
    found = stored(exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select("doc_id", "keep_id", "text_sha256").distinct(), "copies")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    key = [F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__of")]
    gone, repeated = stored(found.filter(~first).select(*key), "gone"), stored(found.filter(first).select(*key), "repeated")
    keyed = docs.withColumn("__sha", F.sha2(normalised(F.col(text_col).cast("string")).cast("binary"), 256))
    same = keyed[id_col].eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__of"))
    rest = keyed.join(small(gone), same, "left_anti")
    if not repeated.isEmpty():
        once = rest.join(small(repeated), same, "left_semi").dropDuplicates([id_col, "__sha"])
        rest = rest.join(small(repeated), same, "left_anti").unionByName(once)
    return rest.select(*docs.columns)


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
