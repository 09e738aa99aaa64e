"""FASTA files read by splits, CG positions, and window counts at any position from prefix sums.

A split's lines are dealt out in pieces. A piece knows its lines in order but neither the record nor the offset that it begins
in; both are carried in from one small row for each earlier piece of the file, as is the one base after a piece's last line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import lookups, ordered

#: Lines of a piece are at most two to this power: a split of 128 MB as one piece is gigabytes in the sorts of its windows.
PIECE = 14


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(record, offset, bases, next_base): each line of bases in upper case, the record's bases before it, and the base after it.

    record is the first word of the header. Blank lines are passed over; bases before any header are an error; next_base
    is null at a record's end. Windows hold the lines of one piece of a split; a line itself is one string.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.btrim("value").alias("v")).where("v <> ''")
    raw = raw.withColumn("split", F.struct("start", F.shiftright("at", PIECE).alias("piece")))  # numbers rise within a split
    head = F.col("v").startswith(">")
    lines = raw.select("file", "split", "at", head.alias("head"), F.when(head, F.regexp_extract("v", r"^>\s*(\S*)", 1)).alias("name"), F.when(~head, F.upper("v")).alias("bases"))
    order = Window.partitionBy("file", "split").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"own": F.last("name", ignorenulls=True).over(so_far), "part": F.sum(F.col("head").cast("int")).over(so_far), "len": F.coalesce(F.length("bases"), F.lit(0)).cast("long")})
    inside = Window.partitionBy("file", "split", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    follow = F.struct(F.lead("head").over(order).alias("h"), F.substring(F.lead("bases").over(order), 1, 1).alias("b"))
    lines = lines.withColumns({"local": F.coalesce(F.sum("len").over(inside), F.lit(0)), "follow": follow})
    # a row a piece: what the pieces after it need
    parts = lines.groupBy("file", "split", "part").agg(F.sum("len").alias("len"), F.max("own").alias("own"), F.min_by(F.struct("head", F.substring("bases", 1, 1).alias("b")), "at").alias("first"))
    ends = parts.groupBy("file", "split").agg(F.max_by("len", "part").alias("tail"), F.max_by("own", "part").alias("name"), F.max("part").alias("heads"), F.min_by("first", "part").alias("first"))
    by_split = Window.partitionBy("file").orderBy("split")
    ends = ends.withColumn("run", F.sum((F.col("heads") > 0).cast("int")).over(by_split))
    ends = ends.withColumns({"sum": F.sum("tail").over(Window.partitionBy("file", "run").orderBy("split")), "last": F.last("name", ignorenulls=True).over(by_split)})
    carried = ends.select("file", "split", F.lag("sum").over(by_split).alias("c_len"), F.lag("last").over(by_split).alias("c_name"), F.lead("first").over(by_split).alias("c_next"))
    whole = lines.where("not head").join(carried, ["file", "split"])
    name = F.coalesce("own", "c_name")
    record = F.when(name.isNotNull(), name).otherwise(F.raise_error(F.lit("bases before any header")))
    after = F.when(F.col("follow.h").isNotNull(), F.when(~F.col("follow.h"), F.col("follow.b"))).otherwise(F.when(~F.col("c_next.head"), F.col("c_next.b")))
    offset = F.col("local") + F.when(F.col("part") == 0, F.coalesce("c_len", F.lit(0))).otherwise(F.lit(0))
    return whole.select(record.alias("record"), offset.alias("offset"), "bases", after.alias("next_base"))


def cg_positions(lines: DataFrame) -> DataFrame:
    """(record, pos): one-based positions of every C that a G follows, over line ends too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records, pos = [], []
            for record, offset, bases in zip(*(b.column(i).to_pylist() for i in range(3))):
                s = np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)
                at = np.flatnonzero((s[:-1] == 67) & (s[1:] == 71)) + offset + 1
                pos.append(at)
                records += [record] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string()), pa.array(np.concatenate(pos) if pos else np.zeros(0, np.int64), pa.int64())], ["record", "pos"])

    joined = lines.select("record", "offset", F.concat("bases", F.coalesce("next_base", F.lit(""))).alias("s"))
    return joined.mapInArrow(run, "record string, pos long")


def _held(bases, what: str):
    return F.length(bases) - F.length(F.replace(bases, F.lit(what), F.lit("")))


def prefix_sums(lines: DataFrame) -> DataFrame:
    """lines with before_<k> and all_<k> for k in gc, cg, n, len: the record's counts before each line, and over all of it."""
    s = F.col("bases")
    cg = (_held(F.concat("bases", F.coalesce("next_base", F.lit(""))), "CG") / 2).cast("long")
    counts = {"gc": (_held(s, "G") + _held(s, "C")).cast("long"), "cg": cg, "n": _held(s, "N").cast("long"), "len": F.length(s).cast("long")}
    return ordered.running(lines.withColumns(counts), "offset", list(counts), ("record",))


def window_counts(windows: DataFrame, prefixes: DataFrame, key: str, stretch: float = 1e6) -> DataFrame:
    """(key, record, lo, hi, gc, cg, n): counts over the half-open bases [lo, hi) of each window, clipped to its record.

    windows: (key unique, record, lo, hi), zero-based. cg counts Cs inside that a G follows, even just outside. Each end is
    an as-of lookup in the prefix sums plus the counts within one line; records that aren't there give nulls.
    """
    ends = windows.select(F.col(key).alias("_k"), "record", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lo").alias("p")), F.struct(F.lit(1).alias("side"), F.col("hi").alias("p")))).alias("e"))
    ends = ends.select("_k", "record", "e.side", F.greatest(F.col("e.p"), F.lit(0)).cast("long").alias("offset"))
    payload = ["bases", "next_base", "before_gc", "before_cg", "before_n", "before_len"]
    found = lookups.last_at_or_before(ends, prefixes.select("record", "offset", *payload), "offset", payload, ("record",), width=stretch)
    within = F.least(F.col("offset") - F.col("mark_at"), F.length("bases").cast("long")).cast("int")
    s = F.substring(F.col("bases"), F.lit(1), within)
    one_more = F.substring(F.concat("bases", F.coalesce("next_base", F.lit(""))), F.lit(1), within + 1)
    at = {"gc": F.col("before_gc") + _held(s, "G") + _held(s, "C"), "cg": F.col("before_cg") + (_held(one_more, "CG") / 2).cast("long"), "n": F.col("before_n") + _held(s, "N"), "len": F.col("before_len") + within}
    told = found.select("_k", "record", "side", *(v.cast("long").alias(k) for k, v in at.items()))
    pick = lambda side, k: F.max(F.when(F.col("side") == side, F.col(k)))
    out = told.groupBy("_k", "record").agg(pick(0, "len").alias("lo"), pick(1, "len").alias("hi"), *((pick(1, k) - pick(0, k)).alias(k) for k in ("gc", "cg", "n")))
    return out.withColumnRenamed("_k", key)


def composition(positions: DataFrame, prefixes: DataFrame, key: str, window: int, stretch: float = 1e6) -> DataFrame:
    """(key, record, gc_content, cg_count) of the bases within `window` of each one-based position: the share of G and C
    among bases other than N (null without any), and the number of CGs."""
    spans = positions.select(key, "record", (F.col("pos") - 1 - window).alias("lo"), (F.col("pos") + window).alias("hi"))
    c = window_counts(spans, prefixes, key, stretch)
    known = F.col("hi") - F.col("lo") - F.col("n")
    return c.select(key, "record", F.when(known > 0, F.col("gc") / known).alias("gc_content"), F.col("cg").alias("cg_count"))


def cg_rate_at_offsets(positions: DataFrame, prefixes: DataFrame, key: str, offsets: tuple[int, ...] = (-1, 0, 1), stretch: float = 1e6) -> DataFrame:
    """(shift, n, rate): the share of positions for which the base `shift` further on is the C of a CG."""
    moved = positions.withColumn("shift", F.explode(F.array(*(F.lit(o) for o in offsets)))).withColumn("_w", F.concat_ws(":", key, "shift"))
    spans = moved.select("_w", "record", (F.col("pos") - 1 + F.col("shift")).alias("lo"), (F.col("pos") + F.col("shift")).alias("hi"))
    hits = window_counts(spans, prefixes, "_w", stretch)
    hits = hits.withColumn("shift", F.substring_index("_w", ":", -1).cast("int"))  # a window's key ends in its shift
    return hits.groupBy("shift").agg(F.count("cg").alias("n"), F.avg("cg").alias("rate"))
