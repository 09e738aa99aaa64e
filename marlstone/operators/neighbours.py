"""Exact nearest vectors by pivots.

Each vector lies in the cell of its nearest pivot; cells near each other make up blocks of bounded size. A query looks into its
own block first; its k-th distance there says which other cells it must visit: those whose pivot is no farther than that distance
plus the cell's radius, and whose side of the bisector it reaches. It is sent once to each block that holds such a cell, and
skips the block's other cells there. Equal vectors are one class with its k + 1 least ids, so copies are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.graph import cut

#: Rows of the base that a task compares at most, and queries a task; pivots at most (they go to every task).
BLOCK, QUERIES, PIVOTS = 16_000, 16_000, 1_024
#: Numbers of a side of a task, likenesses held at once, and rows of a block while there are few.
WIDE, ROOM, LEAST = 2_000_000, 1_000_000, 2_000


def _scaled(v, metric: str) -> np.ndarray:
    x = np.stack(v).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _likeness(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Cosine, or the distance negated; x and y are scaled."""
    return x @ y.T if metric == "cosine" else -np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def _distance(likeness: np.ndarray, metric: str) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * likeness, 0)) if metric == "cosine" else -likeness


def _classes(df: DataFrame, keep: int) -> DataFrame:
    """(rep, ids, v): a row for each distinct vector with its least ids."""
    w = Window.partitionBy("v").orderBy("id")  # the limit is applied before the shuffle, so a hot vector is few rows a task
    few = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "v")


def _rows_at_once(columns: int) -> int:
    """Rows whose distances to so many pivots or cells are held at once."""
    return max(1, ROOM // max(1, columns))


def _located(x: np.ndarray, p: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and its distance, by ROOM distances at most."""
    cell, away, step = np.zeros(len(x), np.int32), np.zeros(len(x)), _rows_at_once(len(p))
    for lo in range(0, len(x), step):
        d = _distance(_likeness(x[lo : lo + step], p, metric), metric)
        cell[lo : lo + step], away[lo : lo + step] = d.argmin(1), d.min(1)
    return cell, away


def _near_order(p: np.ndarray, metric: str) -> list[int]:
    """Pivots in a chain from each to the nearest one left."""
    out, left = [0], np.ones(len(p), bool)
    left[0] = False
    while left.any():
        s = np.where(left, _likeness(p[out[-1:]], p, metric)[0], -np.inf)
        out.append(int(s.argmax()))
        left[out[-1]] = False
    return out


def _first(keep: int, q: np.ndarray, b: np.ndarray, s: np.ndarray, by: np.ndarray):
    """The best `keep` finds (query, base row, likeness) of each query, ties by `by`; with the queries that have so many, and their last likeness."""
    o = np.lexsort((by[b], -s, q))
    q, b, s = q[o], b[o], s[o]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])[: len(q)]
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return q[place < keep], b[place < keep], s[place < keep], q[place == keep - 1], s[place == keep - 1]


def _best(x: np.ndarray, y: np.ndarray, by: np.ndarray, spans: list[tuple[int, int]], go: np.ndarray, floor: np.ndarray, keep: int, metric: str, counted):
    """(query, row, likeness): the best `keep` rows of y for each row of x among the spans it goes to, none below its floor."""
    floor = floor.copy()
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    new, size = [], 0

    def settle():
        nonlocal held, new, size
        *held, full, last = _first(keep, *(np.concatenate(c) for c in zip(held, *new)), by)
        floor[full] = np.maximum(floor[full], last)
        new, size = [], 0

    for j, (lo, hi) in enumerate(spans):
        rows = np.flatnonzero(go[:, j])
        for b in range(lo, hi, ROOM):
            e = min(hi, b + ROOM)
            for c in range(0, len(rows), step := max(1, ROOM // (e - b))):
                at = rows[c : c + step]
                s = _likeness(x[at], y[b:e], metric)
                if counted is not None:
                    counted.add(s.size)
                hit = s >= floor[at][:, None]
                if s.shape[1] > keep and np.count_nonzero(hit) > 4 * keep * len(at):
                    floor[at] = np.maximum(floor[at], np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep])
                    hit = s >= floor[at][:, None]
                i, k = np.nonzero(hit)
                new.append((at[i], b + k, s[i, k]))
                size += len(i)
                if size > 2 * keep * len(x) + ROOM // 4:
                    settle()
    settle()
    return held


def nearest_vectors(vectors: DataFrame, key: str, vector: str, k: int, queries: DataFrame | None = None, metric: str = "cosine", counted=None) -> DataFrame:
    """(query, rank, neighbour, similarity): the exact k nearest other rows of each query, ties by id; no row for a query without any.

    metric: cosine (a zero vector has likeness 0 to all), or euclidean (similarity is the distance negated). Null vectors
    don't count. A row is never its own neighbour: rows are the same if their ids are. counted: an accumulator that
    gets the number of pairs compared. Work is near the square of the rows where the pivots can't tell vectors apart.
    """
    same = queries is None
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    real = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" == (vectors if same else queries).schema[vector].dataType.simpleString() else "array<double>"
    flat = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast(real).alias("v"))
    rows, asked = flat(vectors), flat(vectors if same else queries)
    base = cut(_classes(rows, k + 1))
    n = base.count()
    out = f"query {kind}, neighbour {kind}, similarity double"
    if n == 0:
        return spark.createDataFrame([], "query {0}, rank long, neighbour {0}, similarity double".format(kind))
    ask = base if same else cut(_classes(asked, 1))
    zero = F.forall("v", lambda c: c == 0) if metric == "cosine" else F.lit(False)
    few = min(BLOCK, LEAST)
    some = min(PIVOTS, max(1, int(n**0.5))) if n > few else 1
    pivots = [r.v for r in base.where(~zero).orderBy(F.xxhash64("rep"), "rep").limit(some).collect()]
    # a zero vector has no direction: it is a candidate of everybody, and everybody is its candidate
    least = [r.id for r in rows.orderBy("id").limit(k + 1).collect()] if metric == "cosine" else []
    zeros = [i for r in base.where(zero).select("ids").limit(4).collect() for i in r.ids][: k + 1] if metric == "cosine" else []
    p = _scaled(pivots, metric) if pivots else np.zeros((1, 1))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf["cell"], pdf["away"] = _located(_scaled(pdf.v, metric), p, metric)
                yield pdf

    def located(df: DataFrame) -> DataFrame:
        return cut(df.where(~zero).mapInPandas(locate, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell int, away double"))

    placed = located(base)
    asking = placed if same else located(ask)
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    size = np.array([cells[c].n if c in cells else 0 for c in range(len(p))])
    radius = np.array([cells[c].radius if c in cells else 0.0 for c in range(len(p))])
    slack = 1e-7 * (1.0 + float(np.abs(p).max()) * p.shape[1] ** 0.5 + radius.max())

    wide = max(1, WIDE // p.shape[1])
    side, most = min(BLOCK, wide, max(few, n // 16)), min(QUERIES, wide)
    # cells in a chain fill up blocks; a cell larger than a block is dealt over blocks of its own
    table, blocks, fill = [], 0, 0
    for c in _near_order(p, metric):
        parts = max(1, -(-int(size[c]) // side))
        if fill and (parts > 1 or fill + size[c] > side):
            blocks, fill = blocks + 1, 0
        table.append((int(c), blocks, parts))
        blocks, fill = (blocks + parts, 0) if parts > 1 else (blocks, fill + int(size[c]))
    blocks += fill > 0
    spread = F.broadcast(spark.createDataFrame(table, "cell int, first int, parts int"))  # a row a pivot
    of = np.array([(f, f + k) for _, f, k in sorted(table)])
    block = (F.col("first") + F.pmod(F.xxhash64("rep"), "parts")).cast("int")
    held = placed.join(spread, "cell").select("rep", "ids", "v", "cell", block.alias("block"))
    homes = asking.join(spread, "cell").select("rep", "v", "away", block.alias("home"))
    shares = F.broadcast(spark.createDataFrame([(r.home, -(-r["count"] // most)) for r in homes.groupBy("home").count().collect()], "home int, shares int"))  # a row a block
    homes = homes.join(shares, "home").select("rep", "v", "away", "home", F.pmod(F.xxhash64("rep", F.lit(1)), "shares").cast("int").alias("share"), F.lit(None).cast("double").alias("worst"))

    def bounds(pdf: pd.DataFrame, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether each query must visit each of the cells `which`, by its k-th distance so far (`worst`, null: unknown)."""
        worst, away = pdf.worst.to_numpy(float), pdf.away.to_numpy(float)
        reach = np.where(np.isnan(worst), np.inf, _distance(-np.where(np.isnan(worst), 0, worst), metric)) + slack
        go, step = np.zeros((len(x), len(which)), bool), _rows_at_once(len(which))
        for lo in range(0, len(x), step):
            at = slice(lo, lo + step)
            d = _distance(_likeness(x[at], p[which], metric), metric)
            go[at] = np.maximum(d - radius[which], (d - away[at, None]) / 2) <= reach[at, None]
        return go

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q, b = pdf[pdf.asks], pdf[~pdf.asks].sort_values(["cell", "rep"], kind="stable")
        if not len(q) or not len(b):
            return pd.DataFrame({"query": [], "neighbour": [], "similarity": []})
        cell = b.cell.to_numpy(int)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        x, y = _scaled(q.v, metric), _scaled(b.v, metric)
        by = np.empty(len(b), np.int64)
        by[np.argsort(b.rep.to_numpy(), kind="stable")] = np.arange(len(b))
        floor = -q.worst.astype(float).fillna(np.inf).to_numpy()
        at, row, s = _best(x, y, by, list(zip(starts, np.r_[starts[1:], len(b)])), bounds(q, x, cell[starts]), floor, k + 1, metric, counted)
        if not len(at):
            return pd.DataFrame({"query": [], "neighbour": [], "similarity": []})
        ids = b.ids.to_numpy()[row]
        lengths = np.array([len(i) for i in ids])
        told = pd.DataFrame({"at": np.repeat(at, lengths), "neighbour": np.concatenate(ids), "similarity": np.repeat(s, lengths)})
        told = told.sort_values(["at", "similarity", "neighbour"], ascending=[True, False, True])
        told = told[told.groupby("at").cumcount() <= k]
        return pd.DataFrame({"query": q.rep.to_numpy()[told["at"]], "neighbour": told.neighbour.to_numpy(), "similarity": told.similarity.to_numpy()})

    def met(routed: DataFrame, tiles: DataFrame) -> DataFrame:
        """Candidates of queries in the blocks they were sent to; a task is a share of a home's queries and a block. tiles: (home, share, block), a row a task."""
        no = lambda kind: F.lit(None).cast(kind)
        q = routed.select("home", "share", "block", "rep", "v", no(f"array<{kind}>").alias("ids"), no("int").alias("cell"), "away", "worst", F.lit(True).alias("asks"))
        b = held.join(tiles, "block").select("home", "share", "block", "rep", "v", "ids", "cell", no("double").alias("away"), no("double").alias("worst"), F.lit(False).alias("asks"))
        return q.unionByName(b).groupBy("home", "share", "block").applyInPandas(search, out)

    entry = F.struct((-F.col("similarity")).alias("s"), F.col("neighbour").alias("i"))
    best = lambda found: found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("b"))
    at_home = homes.withColumn("block", F.col("home"))
    found = best(met(at_home, F.broadcast(shares.select("home", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("home").alias("block")))))
    if blocks > 1:
        found = cut(found)  # read twice below
        far = F.when(F.size("b") > k, F.col("b")[k]["s"]).alias("worst")
        bound = homes.drop("worst").join(found.select(F.col("query").alias("rep"), far), "rep", "left")
        every = np.flatnonzero(size > 0)

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                go = bounds(pdf, _scaled(pdf.v, metric), every)
                to = np.zeros((len(pdf), blocks), bool)
                for j, c in enumerate(every):
                    to[:, of[c, 0] : of[c, 1]] |= go[:, j : j + 1]
                to[np.arange(len(pdf)), pdf.home.to_numpy(int)] = False
                yield pdf.assign(blocks=[np.flatnonzero(t).astype(np.int32) for t in to])

        routed = cut(bound.mapInPandas(route, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bound.schema) + ", blocks array<int>"))
        sent = routed.withColumn("block", F.explode("blocks")).drop("blocks")
        tiles = cut(sent.select("home", "share", "block").distinct())
        one = found.select("query", F.explode("b").alias("e")).select("query", F.col("e.i").alias("neighbour"), (-F.col("e.s")).alias("similarity"))
        found = cut(best(one.unionByName(met(sent, tiles))))
    if zeros:
        more = F.array(*(F.struct(F.lit(-0.0).alias("s"), F.lit(i).cast(kind).alias("i")) for i in zeros))
        found = found.withColumn("b", F.slice(F.array_sort(F.concat("b", more)), 1, k + 1))
    answers = asking.select("rep", "v").join(found.withColumnRenamed("query", "rep"), "rep").select("v", "b")
    if metric == "cosine":
        all_ = F.array(*(F.struct(F.lit(-0.0).alias("s"), F.lit(i).cast(kind).alias("i")) for i in least))
        answers = answers.unionByName(ask.where(zero).select("v", all_.alias("b")))
    told = asked.join(answers, "v").select(F.col("id").alias("query"), F.slice(F.filter("b", lambda e: e["i"] != F.col("id")), 1, k).alias("b"))
    return told.select("query", F.posexplode("b").alias("rank", "e")).select("query", (F.col("rank") + 1).cast("long").alias("rank"), F.col("e.i").alias("neighbour"), (-F.col("e.s")).alias("similarity"))
