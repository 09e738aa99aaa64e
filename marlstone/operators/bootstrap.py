"""Bootstraps over shared block draws, crossed units and mixtures of match seeds, in a fixed number of passes.

A draw weighs every row by how often its block was drawn, so a rank statistic under any draw is a polynomial in those
multiplicities: its coefficients (how often a row of block g lies above one of block h, and so on) are counted once, and
all replicates are small products on the driver. Where rows are drawn one by one, draw k of replicate r is a hash of
(seed, r, k), and counts come from an aggregation; the counts of a replicate add up to the number of units exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import ordered
from marlstone.operators.contracts import require_unique
from marlstone.operators.splits import hash_positions
from marlstone.sources.sinks import written

#: Blocks at most: the moments of a correlation are blocks**3 numbers.
MOST_BLOCKS = 64
#: Pairs whose scores one task holds.
PART = 500_000


def drawn(n: Column | int, *parts: Column | str | int) -> Column:
    """A number below n that looks random: leading 48 bits of the sha256 of the parts joined by colons, modulo n."""
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else F.lit(p).cast("string") if isinstance(p, int) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long") % (F.lit(n) if isinstance(n, int) else n)


def pcg_draws(blocks: int, replicates: int, seed: int) -> np.ndarray:
    """replicates x blocks multiplicities of numpy's PCG64 stream: each row is `blocks` draws with replacement."""
    draws = np.random.Generator(np.random.PCG64(seed)).integers(0, blocks, size=(replicates, blocks))
    return np.stack([np.bincount(r, minlength=blocks) for r in draws]).astype(np.float64)


def hash_counts(spark: SparkSession, n: int, replicates: int, seed: int, salt: str) -> DataFrame:
    """(replicate, unit, times): n draws of the units 0..n-1 a replicate; units that weren't drawn have no row."""
    k = spark.range(n * replicates).select((F.col("id") / n).cast("long").alias("replicate"), (F.col("id") % n).alias("k"))
    return k.withColumn("unit", drawn(n, seed, F.lit(salt), "replicate", "k")).groupBy("replicate", "unit").agg(F.count("*").alias("times"))


def hash_draws(spark: SparkSession, blocks: int, replicates: int, seed: int) -> np.ndarray:
    """The multiplicities of hash_counts for few blocks, as a matrix."""
    out = np.zeros((replicates, blocks))
    for r in hash_counts(spark, blocks, replicates, seed, "block").collect():
        out[r.replicate, r.unit] = r.times
    return out


def _numbered(df: DataFrame, block: str, blocks: list) -> DataFrame:
    """df with _g, the place of its block in blocks; an error for a block outside."""
    if not 0 < len(blocks) <= MOST_BLOCKS:
        raise ValueError(f"1 to {MOST_BLOCKS} blocks, not {len(blocks)}")
    place = F.array_position(F.array(*(F.lit(b) for b in blocks)), F.col(block))
    return df.withColumn("_g", F.when(place > 0, place - 1).otherwise(F.raise_error(F.lit("a row lies outside the declared blocks")).cast("long")))


def _held(name: str, g: int, count: Column | None = None) -> list[Column]:
    c = F.lit(1) if count is None else count
    return [F.sum(F.when(F.col("_g") == i, c).otherwise(F.lit(0))).alias(f"{name}{i}") for i in range(g)]


def _below(name: str, g: int) -> Column:
    """For each block: what lies below this value, and half of what ties with it."""
    return F.array(*((F.col(f"before_{name}{i}") + F.col(f"{name}{i}") / 2).cast("double") for i in range(g)))


def _added(df: DataFrame, arm: str, part, size: int) -> dict:
    """arm -> sum over its rows of part(rows), a flat array; one small row an arm and task comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for a, rows in pdf.groupby(arm, sort=False, dropna=False):
                total[a] = total.get(a, 0) + part(rows)
        yield pd.DataFrame({"a": list(total), "v": [v.tolist() for v in total.values()]})

    kind = df.schema[arm].dataType.simpleString()
    out: dict = {}
    for r in df.mapInPandas(run, f"a {kind}, v array<double>").groupBy("a").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(size))).alias("v") if size <= 64 else F.collect_list("v").alias("v")).collect():
        out[r.a] = np.array(r.v) if size <= 64 else np.sum(r.v, axis=0)
    return out


def auroc_replicates(df: DataFrame, arm: str, score: str, positive: Column, block: str, blocks: list, draws: np.ndarray) -> dict:
    """arm -> (AUROC, its replicates), ties as half, from one scan; NaN where a draw lacks a class. Null scores don't count."""
    g = len(blocks)
    rows = _numbered(df.where(F.col(score).isNotNull() & F.col(block).isNotNull()).withColumn("_p", F.coalesce(positive, F.lit(False))), block, blocks)
    groups = rows.groupBy(arm, score).agg(*_held("p", g, F.col("_p").cast("long")), *_held("n", g, (~F.col("_p")).cast("long")))
    run = ordered.running(groups, score, [f"n{i}" for i in range(g)], (arm,))
    flat = run.select(arm, F.array(*(F.col(f"p{i}").cast("double") for i in range(g))).alias("p"), F.array(*(F.col(f"n{i}").cast("double") for i in range(g))).alias("n"), _below("n", g).alias("below"))

    def part(rows: pd.DataFrame) -> np.ndarray:
        p, n, below = (np.stack(rows[c]) for c in ("p", "n", "below"))
        return np.concatenate([(p.T @ below).ravel(), p.sum(0), n.sum(0)])

    def value(v: np.ndarray, m: np.ndarray) -> np.ndarray:
        u, p, n = v[: g * g].reshape(g, g), m @ v[g * g : g * g + g], m @ v[g * g + g :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where((p > 0) & (n > 0), np.einsum("bi,ij,bj->b", m, u, m) / (p * n), np.nan)

    return {a: (float(value(v, np.ones((1, g)))[0]), value(v, draws)) for a, v in _added(flat, arm, part, g * g + 2 * g).items()}


def spearman_replicates(df: DataFrame, arm: str, x: str, y: str, block: str, blocks: list, draws: np.ndarray, weight: Column | None = None) -> dict:
    """arm -> (Spearman, its replicates): Pearson of weighted mid-ranks, from two orderings and one scan.

    weight: what a row counts (of mean 1 or so); a draw multiplies it."""
    g = len(blocks)
    rows = _numbered(df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(block).isNotNull()), block, blocks)
    cells = rows.groupBy(arm, x, y, "_g").agg((F.count("*") if weight is None else F.sum(weight)).alias("_c"))

    def below(v: str, name: str) -> DataFrame:
        groups = cells.groupBy(arm, v).agg(*_held("n", g, F.col("_c")))
        return ordered.running(groups, v, [f"n{i}" for i in range(g)], (arm,)).select(arm, v, _below("n", g).alias(name))

    flat = cells.join(below(x, "a"), [arm, x]).join(below(y, "b"), [arm, y]).select(arm, "_g", "_c", "a", "b")
    cube = g**3

    def part(rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros((3, g, g, g))
        first = np.zeros((2, g, g))
        count = np.zeros(g)
        for k, own in rows.groupby("_g"):
            a, b, w = np.stack(own["a"]), np.stack(own["b"]), own["_c"].to_numpy(float)
            wa, wb = a * w[:, None], b * w[:, None]
            out[0, k], out[1, k], out[2, k] = wa.T @ b, wa.T @ a, wb.T @ b
            first[0, k], first[1, k], count[k] = wa.sum(0), wb.sum(0), w.sum()
        return np.concatenate([out.ravel(), first.ravel(), count])

    def value(v: np.ndarray, m: np.ndarray) -> np.ndarray:
        third, first, count = v[: 3 * cube].reshape(3, g, g * g), v[3 * cube : 3 * cube + 2 * g * g].reshape(2, g, g), v[-g:]
        total = m @ count
        both = np.einsum("bi,bj->bij", m, m).reshape(len(m), g * g)
        uv, uu, vv = (np.einsum("bk,bk->b", m @ t, both) / total**2 for t in third)
        u, w = (np.einsum("bi,ij,bj->b", m, t, m) / total for t in first)
        with np.errstate(invalid="ignore", divide="ignore"):
            su, sv = uu - u * u / total, vv - w * w / total
            return np.where((su > 1e-12 * total) & (sv > 1e-12 * total), (uv - u * w / total) / np.sqrt(su * sv), np.nan)

    return {a: (float(value(v, np.ones((1, g)))[0]), value(v, draws)) for a, v in _added(flat, arm, part, 3 * cube + 2 * g * g + g).items()}


def ratio_replicates(df: DataFrame, arm: str, over: Column, under: Column, block: str, blocks: list, draws: np.ndarray) -> dict:
    """arm -> (sum of over / sum of under, its replicates); NaN where a draw's divisor is 0. A row an arm and block comes back."""
    place = {b: i for i, b in enumerate(blocks)}
    held: dict = {}
    for r in df.groupBy(F.col(arm).alias("a"), F.col(block).alias("b")).agg(F.sum(over).alias("p"), F.sum(under).alias("q")).collect():
        held.setdefault(r.a, np.zeros((2, len(blocks))))[:, place[r.b]] = [r.p or 0.0, r.q or 0.0]
    m = np.vstack([np.ones((1, len(blocks))), draws])
    out = {}
    for a, (p, q) in held.items():
        with np.errstate(invalid="ignore", divide="ignore"):
            v = np.where(m @ q != 0, (m @ p) / (m @ q), np.nan)
        out[a] = (float(v[0]), v[1:])
    return out


def interval(replicates: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile interval of the finite replicates."""
    r = replicates[np.isfinite(replicates)]
    return tuple(float(v) for v in np.quantile(r, [alpha / 2, 1 - alpha / 2])) if len(r) else (float("nan"), float("nan"))


def contrast(a: tuple[float, np.ndarray], b: tuple[float, np.ndarray]) -> dict:
    """a - b with interval and two-sided p over the draws that both share; p counts the observed value on both sides."""
    if a[1].shape != b[1].shape:
        raise ValueError("replicates of different draws")
    d = a[1] - b[1]
    lo, hi = interval(d)
    d = d[np.isfinite(d)]
    p = min(1.0, 2 * min((1 + int((d <= 0).sum())) / (1 + len(d)), (1 + int((d >= 0).sum())) / (1 + len(d))))
    return {"delta": a[0] - b[0], "ci_lo": lo, "ci_hi": hi, "p": p}


def paired_crossed(reference: DataFrame, alternative: DataFrame, unit: str, item: str, block: str, replicates: int = 1000, seed: int = 17) -> DataFrame:
    """One row: the paired difference of mean squared error under draws of units and of blocks, crossed.

    Both tables have (unit, item, block, target, squared_error, n), keyed by the first three; different keys, targets
    (beyond 1e-7) or counts are an error, as are fewer than two units or blocks. Cells of unit x block are added up once.
    """
    key = [unit, item, block]
    r = require_unique(reference, *key).select(*key, F.col("target").alias("_t"), F.col("squared_error").alias("_r"), F.col("n").alias("_n"), F.lit(True).alias("_in_r"))
    a = require_unique(alternative, *key).select(*key, F.col("target").alias("_u"), F.col("squared_error").alias("_a"), F.col("n").alias("_m"), F.lit(True).alias("_in_a"))
    same = F.col("_in_r") & F.col("_in_a") & (F.abs(F.col("_t") - F.col("_u")) <= 1e-7) & (F.col("_n") == F.col("_m"))
    fault = F.raise_error(F.lit("predictions are not paired on identical keys, targets and counts")).cast("double")
    pairs = r.join(a, key, "full").withColumn("_d", F.when(same, F.col("_a") - F.col("_r")).otherwise(fault))
    # a row a unit and block: written, since five branches read it and the pairs must be made once
    cells = written(pairs.groupBy(unit, block).agg(F.sum(F.col("_n") * F.col("_d")).alias("delta"), F.sum(F.col("_n") * F.col("_r")).alias("base"), F.sum("_n").alias("obs"), F.count("*").alias("pairs")))
    units, blocks = (hash_positions(cells.select(c).distinct(), c, seed).select(c, F.col("_rn").alias(f"_{c}")) for c in (unit, block))
    nu, nb = units.count(), blocks.count()
    if nu < 2 or nb < 2:
        raise ValueError("several units and several blocks are needed")
    spark = reference.sparkSession
    placed = cells.join(units, unit).join(blocks, block)
    wu = hash_counts(spark, nu, replicates, seed, "unit").select("replicate", F.col("unit").alias(f"_{unit}"), F.col("times").alias("_wu"))
    wb = hash_counts(spark, nb, replicates, seed, "block").select("replicate", F.col("unit").alias(f"_{block}"), F.col("times").alias("_wb"))
    weigh = lambda w: [F.sum(F.col(w) * F.col(c)).alias(c) for c in ("delta", "base", "obs")]
    by_block = placed.join(wu, f"_{unit}").groupBy("replicate", f"_{block}").agg(*weigh("_wu"))
    sums = by_block.join(wb, ["replicate", f"_{block}"]).groupBy("replicate").agg(*weigh("_wb"))
    whole = cells.agg((F.sum("delta") / F.sum("obs")).alias("delta_mse"), (F.sum("delta") / F.sum("base")).alias("relative_delta_mse"), F.sum("pairs").alias("n_pairs"), F.sum("obs").alias("n_observations"))
    est = F.when(F.col("obs") > 0, F.col("delta") / F.col("obs"))
    rel = F.when(F.col("base") > 0, F.col("delta") / F.col("base"))
    told = sums.select(est.alias("e"), rel.alias("q")).crossJoin(F.broadcast(whole))  # a row a replicate, and one row
    out = told.groupBy("delta_mse", "relative_delta_mse", "n_pairs", "n_observations").agg(
        F.percentile("e", 0.025).alias("ci_lo"),
        F.percentile("e", 0.975).alias("ci_hi"),
        F.percentile("q", 0.025).alias("relative_ci_lo"),
        F.percentile("q", 0.975).alias("relative_ci_hi"),
        ((1 + F.count_if(F.abs(F.col("e") - F.col("delta_mse")) >= F.abs("delta_mse"))) / (1 + F.count("e"))).alias("p"),
    )
    return out.withColumns({"n_units": F.lit(nu), "n_blocks": F.lit(nb)})


def seed_mixture(pairs: DataFrame, match_seed: str, block: str, pair: str, arms: dict[str, tuple[str, str]], replicates: int, seed: int) -> DataFrame:
    """(arm, replicate, match_seed, auroc): each replicate takes one match seed, and draws that seed's pairs within each block.

    arms: name -> (score of the positive, score of the negative) of a pair; a drawn pair brings both its scores into every
    arm alike. Pair ids (numeric) are unique within a match seed. Seeds are few; the work is pairs x replicates / seeds rows.
    Each draw is shuffled once, as a number of the drawn pair and its replicate, and meets the pair's scores unsorted.
    """
    seeds = [r[0] for r in pairs.select(match_seed).where(F.col(match_seed).isNotNull()).distinct().orderBy(match_seed).limit(10_001).collect()]
    if not 0 < len(seeds) <= 10_000:
        raise ValueError("1 to 10,000 match seeds")
    spark = pairs.sparkSession
    chosen = spark.range(replicates).select(F.col("id").alias("replicate"), F.element_at(F.array(*(F.lit(s) for s in seeds)), (drawn(len(seeds), seed, F.lit("seed"), "id") + 1).cast("int")).alias(match_seed))
    scores = [c for v in arms.values() for c in v]
    slim = pairs.select(match_seed, block, pair, *dict.fromkeys(scores)).withColumn("_one", F.lit(1))
    numbered = ordered.running(slim, pair, ["_one"], (match_seed, block)).withColumnsRenamed({"before__one": "_k", "all__one": "_m"})
    numbered = written(numbered.select(match_seed, block, "_k", "_m", *dict.fromkeys(scores)))  # read for the groups' sizes, the draws and the scores
    # groups (seeds x blocks, few) follow each other in one numbering of all pairs
    sizes = numbered.groupBy(match_seed, block).agg(F.max("_m").alias("_size"))
    first = Window.orderBy(match_seed, block).rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.join(F.broadcast(sizes.withColumn("_first", F.coalesce(F.sum("_size").over(first), F.lit(0))).drop("_size")), [match_seed, block])
    # draw k of a block falls on one of its pairs; replicates are few, so their table goes to the rows
    hits = placed.select(match_seed, block, "_k", "_m", "_first").join(F.broadcast(chosen), match_seed)
    hits = hits.select("replicate", (F.col("_first") + drawn(F.col("_m"), seed, "replicate", block, "_k")).alias("_place"))
    held = placed.select((F.col("_first") + F.col("_k")).alias("_place"), match_seed, *dict.fromkeys(scores))
    # so many parts that a part's scores are a small table
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), numbered.count() // PART + 1)
    drawn_pairs = hits.repartition(parts, "_place").join(held.repartition(parts, "_place").hint("shuffle_hash"), "_place")
    sides = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(i == 0).alias("positive"), F.col(c).cast("double").alias("score")) for a, v in arms.items() for i, c in enumerate(v)))).alias("s")
    rows = drawn_pairs.select("replicate", match_seed, sides).select("replicate", match_seed, "s.*")
    return ordered.auroc(rows, "score", F.col("positive"), ("arm", "replicate", match_seed)).select("arm", "replicate", match_seed, "auroc")


def mixture_report(pairs: DataFrame, match_seed: str, block: str, pair: str, arms: dict[str, tuple[str, str]], replicates: int, seed: int, comparisons: list[tuple[str, str]]) -> DataFrame:
    """(kind, arm, comparison, estimate, between_seed_sd, ci_lo, ci_hi, seed_min, seed_max, p): each arm's AUROC and each
    difference a - b; estimates are means over match seeds, intervals those of the mixture.
    """
    side = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(i == 0).alias("positive"), F.col(c).cast("double").alias("score")) for a, v in arms.items() for i, c in enumerate(v)))).alias("s")
    by_seed = ordered.auroc(pairs.select(match_seed, side).select(match_seed, "s.*"), "score", F.col("positive"), ("arm", match_seed))
    boot = seed_mixture(pairs, match_seed, block, pair, arms, replicates, seed)
    # seeds and replicates are few rows an arm; arms become columns of one row a seed or replicate
    names = list(arms)
    wide = lambda df, k: df.groupBy(*k).agg(*(F.max(F.when(F.col("arm") == n, F.col("auroc"))).alias(f"_{i}") for i, n in enumerate(names)))
    value = [(F.lit("auc"), n, "", F.col(f"_{i}")) for i, n in enumerate(names)]
    value += [(F.lit("delta"), a, f"{a} - {b}", F.col(f"_{names.index(a)}") - F.col(f"_{names.index(b)}")) for a, b in comparisons]
    long = lambda df: df.select(F.explode(F.array(*(F.struct(k.alias("kind"), F.lit(a).alias("arm"), F.lit(c).alias("comparison"), v.alias("v")) for k, a, c, v in value))).alias("s")).select("s.*")
    key = ["kind", "arm", "comparison"]
    points = long(wide(by_seed, [match_seed])).groupBy(*key).agg(F.avg("v").alias("estimate"), F.stddev_samp("v").alias("between_seed_sd"), F.min("v").alias("seed_min"), F.max("v").alias("seed_max"))
    n = F.count("v")
    least = F.least(F.count_if(F.col("v") <= 0) / n, F.count_if(F.col("v") >= 0) / n)
    spread = long(wide(boot, ["replicate"])).groupBy(*key).agg(F.percentile("v", 0.025).alias("ci_lo"), F.percentile("v", 0.975).alias("ci_hi"), F.least(F.lit(1.0), 2 * (least + 1 / (n + 1))).alias("_p"))
    return points.join(spread, key).withColumn("p", F.when(F.col("kind") == "delta", F.col("_p"))).drop("_p")
