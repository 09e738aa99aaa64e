"""Queries over stores of vectors: gathers, similarities after the covariance is removed, profile ridge and its scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import vectors
from marlstone.operators import bootstrap, geometry, lookups, profiles
from marlstone.plans.registry import query
from marlstone.session import table

WIDTH = 64  # of the embeddings table


@query(
    "sc5_aligned_gather",
    "SELECT p_partkey, embedding IS NOT NULL AS covered, round(coalesce(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 0), 5) AS energy FROM part LEFT JOIN embeddings ON vec_id = p_partkey",
)
def _(spark, sf_dir):
    """The vectors in the order of another axis, with zeros where the store has none."""
    store = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    got = lookups.aligned_gather(table(spark, sf_dir, "part").select("p_partkey"), store, "p_partkey", "embedding", WIDTH, fill=True)
    return got.select("p_partkey", "covered", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 5).alias("energy"))


@query(
    "sc6_strict_gather",
    "SELECT l_suppkey, count(*) AS n, round(sum(embedding[1]::DOUBLE), 5) AS first FROM lineitem JOIN embeddings ON vec_id = l_suppkey GROUP BY 1",
)
def _(spark, sf_dir):
    """A vector for every line of every order, keys repeated as often as they occur."""
    store = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("l_suppkey"), "embedding")
    got = lookups.strict_gather(table(spark, sf_dir, "lineitem").select("l_suppkey"), store, "l_suppkey", "embedding", WIDTH)
    return got.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 5).alias("first"))


#: Each vector with three others, drawn by hash; ids run from 0.
DRAWN_PAIRS = "n AS (SELECT count(*) AS n FROM embeddings), q AS (SELECT vec_id AS i, ('0x' || substr(sha256('29:' || vec_id || ':' || k), 1, 12))::BIGINT % n AS j FROM embeddings, range(3) t(k), n), ij AS (SELECT DISTINCT i, j FROM q WHERE i <> j)"


def drawn_pairs(e):
    n = e.count()
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    return e.select(F.col("vec_id").alias("i"), k).select("i", bootstrap.drawn(n, 29, "i", "k").alias("j")).where("i <> j").distinct()


@query(
    "ar3_standardised_cosine",
    f"""WITH {DRAWN_PAIRS}, x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT k, avg(x) AS m, stddev_pop(x) AS sd FROM x GROUP BY 1),
    z AS (SELECT vec_id, k, x - m AS c, (x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM x JOIN m USING (k))
    SELECT i, j, round(sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 5) AS centred, round(sum(a.z * b.z) / sqrt(sum(a.z * a.z) * sum(b.z * b.z)), 5) AS standardised FROM ij JOIN z a ON a.vec_id = i JOIN z b ON b.vec_id = j AND b.k = a.k GROUP BY i, j""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    got = geometry.similarities(e, "vec_id", "embedding", drawn_pairs(e), geometry.spectrum(e, "embedding"), removed=(0,))
    return got.select("i", "j", F.round("centred_0", 5).alias("centred"), F.round("standardised", 5).alias("standardised"))


@query("ar3_spectral_cosines")
def _(spark, sf_dir):
    """Cosines with one, three and ten leading axes removed, and whitened."""
    e = table(spark, sf_dir, "embeddings")
    got = geometry.similarities(e, "vec_id", "embedding", drawn_pairs(e), geometry.spectrum(e, "embedding"), removed=(1, 3, 10))
    return got.select("i", "j", *(F.round(c, 5).alias(c) for c in ("centred_1", "centred_3", "centred_10", "whitened")))


#: The last eight components are a row's profile, the first 32 its features; folds by label.
PROFILE = "e AS (SELECT vec_id, label, label % 5 AS fold, list_slice(embedding::DOUBLE[], 57, 64) AS p, list_slice(embedding::DOUBLE[], 1, 8) AS q FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"


def profile_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    return e.select("vec_id", "label", (F.col("label") % 5).alias("fold"), F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 57, 8).alias("p"), F.slice("embedding", 1, 8).alias("q"))


@query(
    "ml10_train_mean_baseline",
    f"""WITH {PROFILE}, r AS (SELECT vec_id, fold, unnest(p) AS y, generate_subscripts(p, 1) AS k FROM e), c AS (SELECT *, avg(y) OVER (PARTITION BY vec_id) AS level FROM r),
    t AS (SELECT 'raw' AS kind, vec_id, fold, k, y FROM c UNION ALL SELECT 'centred', vec_id, fold, k, y - level FROM c UNION ALL SELECT 'level', vec_id, fold, 1, level FROM c WHERE k = 1),
    s AS (SELECT kind, fold, k, sum(y) AS s, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT kind, fold, k, (sum(s) OVER (PARTITION BY kind, k) - s) / (sum(n) OVER (PARTITION BY kind, k) - n) AS mean FROM s),
    g AS (SELECT kind, k, count(*) AS n, sum(power(y - mean, 2)) AS sse, sum(y * y) - power(sum(y), 2) / count(*) AS sst FROM t JOIN m USING (kind, fold, k) GROUP BY ALL)
    SELECT kind, max(n) AS n, round(1 - sum(sse) / sum(sst), 5) AS r2_global, round(avg(1 - sse / sst), 5) AS r2_macro FROM g GROUP BY kind""",
)
def _(spark, sf_dir):
    """What the other folds' mean profile explains, in raw, centred and level form."""
    rows = profiles.complete(profile_rows(spark, sf_dir), "p")
    out = []
    for kind, form in profiles.forms(F.col("p")).items():
        told = profiles.against_train_mean(rows.withColumn("y", form), "y", "fold")
        s = profiles.block_sums(told.withColumn("all", F.lit(0)), "y", "baseline", "all")
        sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
        out.append(s.agg(F.max("n").alias("n"), F.round(1 - F.sum("sse") / F.sum(sst), 5).alias("r2_global"), F.round(F.avg(1 - F.col("sse") / sst), 5).alias("r2_macro")).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("ml10_profile_ridge")
def _(spark, sf_dir):
    """Out-of-fold scores of the profile ridge in each form beside the train mean, with intervals under shared draws of labels."""
    fit, _b, _a = profiles.fitted(profile_rows(spark, sf_dir), "x", "p", "fold", (0.1, 10.0, 1000.0))
    labels = [r[0] for r in fit.select("label").distinct().orderBy("label").limit(64).collect()]  # blocks are few: 64 at most
    draws = bootstrap.hash_draws(spark, len(labels), 200, 17)
    rows = []
    for kind in profiles.KINDS:
        for model, p in (("ridge", f"{kind}_oof"), ("train_mean", "baseline")):
            told = fit if model == "ridge" else profiles.against_train_mean(fit, kind, "fold")
            for name, (v, reps) in profiles.scores(told, kind, p, "label", labels, draws).items():
                rows.append((kind, model, name, round(v, 5), *(round(c, 5) for c in bootstrap.interval(reps))))
    return spark.createDataFrame(rows, "kind string, model string, metric string, value double, lo double, hi double")


@query(
    "ag24_multi_output_sums",
    f"""WITH {PROFILE}, c AS (SELECT vec_id, label, unnest(p) AS y, unnest(q) AS p FROM e), r AS (SELECT vec_id, label, corr(y, p) AS r FROM c GROUP BY 1, 2), b AS (SELECT label, round(sum(r), 5) AS r_sum, count(r) AS r_n FROM r GROUP BY 1)
    SELECT label, count(*) AS n, round(sum(y), 5) AS sy, round(sum(p), 5) AS sp, round(sum(y * y), 5) AS syy, round(sum(p * p), 5) AS spp, round(sum(y * p), 5) AS syp, round(sum(power(y - p, 2)), 5) AS sse, any_value(r_sum) AS r_sum, any_value(r_n) AS r_n FROM c JOIN b USING (label) GROUP BY 1""",
)
def _(spark, sf_dir):
    """Sums by label of measured and predicted profiles of eight values, and of the rows' own correlations."""
    rows = profile_rows(spark, sf_dir)
    s = profiles.block_sums(rows, "p", "q", "label").groupBy("block").agg(F.sum("n").alias("n"), *(F.round(F.sum(c), 5).alias(c) for c in ("sy", "sp", "syy", "spp", "syp", "sse")))
    r = profiles.block_correlations(rows, "p", "q", "label").withColumn("r_sum", F.round("r_sum", 5))
    return s.join(r, "block").withColumnRenamed("block", "label")


@query(
    "cq13_level_r2",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), l AS (SELECT k, avg(x) AS l FROM x GROUP BY 1)
    SELECT vec_id, round(power(corr(x, l), 2), 5) AS r2 FROM x JOIN l USING (k) GROUP BY 1""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return profiles.r2_with_level(e, "embedding").select("vec_id", F.round("r2", 5).alias("r2"))
