"""Exact dedup by an extendible-hash index in the shared folder; DataFrame expressions only.

Pages (row, id, key, digest, text) are written once. The directory doubles until each bucket of keys by their leading bits
fits, which whatever order of arrival ends in the same buckets; neighbouring buckets make up the key range of an owner.
Owner tasks chain the distinct texts of a key, comparing bytes. A row looks its key up in the index; where a chain holds
more than one text, it is found by key and bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch, partitions

#: Keys a bucket holds before it splits; the directory's depth at most (beyond, buckets grow: 2**18 small rows are broadcast).
CAPACITY, MOST_DEPTH = 256, 18
#: Copies of a key that go to its owner as they are; HOT_KEYS bounds how many keys can have more than a share of the rows.
COPIES, HOT_KEYS = 64, 4096


def normalised(text: Column) -> Column:
    """Each run of blanks, tabs and line ends as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def directory(keys: DataFrame, rows: int, owners: int, capacity: int) -> tuple[DataFrame, int]:
    """((cell, bucket, owner), depth): the bucket and owner of each leading `depth` bits that some key of keys (key, held) has.

    A bucket splits while it has more than capacity keys and its local depth is below the directory's; so a cell's bucket is
    its shortest prefix that fits. Owners are ranges of buckets with about equal numbers of rows (held).
    """
    depth = min(MOST_DEPTH, max(1, math.ceil(math.log2(max(2, rows / capacity))) + 4))
    cells = keys.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("cell")).agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    levels = cells.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, cast({depth} - d as int))"))
    fits = levels.groupBy("d", "prefix").agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.col("d") == depth)).select("d", "prefix")
    local = levels.join(F.broadcast(fits), ["d", "prefix"]).groupBy("cell").agg(F.min("d").alias("d"), F.first("held").alias("held"))
    # fits has fewer than 2 ** (MOST_DEPTH + 1) rows; the number of a bucket is its place in the heap of all prefixes
    placed = local.withColumn("bucket", F.expr(f"shiftleft(1L, d) + shiftrightunsigned(cell, cast({depth} - d as int))"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over cells, 2**MOST_DEPTH at most
    dealt = placed.withColumn("_sum", F.sum("held").over(before)).withColumn("_all", F.sum("held").over(Window.partitionBy(F.lit(0))))
    owner = F.floor((F.col("_sum") - 1) * owners / F.greatest("_all", F.lit(1))).cast("int")
    return dealt.select("cell", "bucket", F.max(owner).over(Window.partitionBy("bucket")).alias("owner")), depth


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    Null text is the empty text and equal to it. Of equal texts the row of least id stays; null ids come last, and of
    rows that repeat both id and text exactly one stays. An empty table gives no rows; other columns are never read.
    key_bits below 64 makes keys collide, for tests. A third of all rows may be one text: keys with more than COPIES rows
    are added up before they are dealt out, and the last join has exchanges right below it, which Spark can split.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = normalised(F.col(text_col))
    key = F.xxhash64("text").bitwiseAND(F.lit(-1 << (64 - key_bits)))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    pages = scratch.table(plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", key.alias("key"), F.unhex(F.sha2("text", 256)).alias("digest"), "text"))
    rows = pages.count()
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id"))
    keys = scratch.table(pages.groupBy("key").agg(F.count("*").alias("n"), first.alias("head")))
    line = max(COPIES, rows // HOT_KEYS)
    held = F.when(F.col("n") > line, 1).otherwise(F.col("n"))
    owners = partitions(spark)
    cells, depth = directory(keys.select("key", held.alias("held")), rows, owners, capacity)
    cells = scratch.table(cells)
    hot = keys.where(F.col("n") > line).select("key")  # HOT_KEYS at most
    some = pages.select("doc_id", "key", "text")
    cold = some.join(F.broadcast(hot), "key", "left_anti").select("key", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    warm = some.join(F.broadcast(hot), "key", "left_semi").groupBy("key", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    cell = F.shiftrightunsigned("key", 64 - depth).alias("cell")
    dealt = cold.unionByName(warm).withColumn("cell", cell).join(F.broadcast(cells), "cell").drop("cell").repartitionById(owners, F.col("owner"))
    texts = dealt.groupBy("owner", "bucket", "key", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chain = Window.partitionBy("owner", "bucket", "key")
    chained = texts.withColumn("links", F.count("*").over(chain))
    # the text is kept where its key's chain has others
    index = scratch.table(chained.select("bucket", "key", "keep_id", "group_size", "links", F.when(F.col("links") > 1, F.col("text")).alias("text")))
    single = scratch.table(index.where("links = 1").select("key", "keep_id", "group_size").join(keys.select("key", "head"), "key"))
    # pages lie by input, single by key: both sides of this join have an exchange of their own, right below it
    found = pages.select("row", "doc_id", "key", "digest").join(single, "key")
    several = index.where("links > 1").select("key", "text", "keep_id", "group_size")
    if not several.isEmpty():
        heads = pages.join(several.select("key").distinct(), "key", "left_semi").groupBy("key", "text").agg(first.alias("head"))
        told = scratch.table(several.join(heads, ["key", "text"]))
        found = found.unionByName(pages.join(told, ["key", "text"]).select(found.columns))
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("head")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


REPORT_SQL = r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)"""
