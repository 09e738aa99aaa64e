"""Queries of coordinates, maths, strings, arrays and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import coords, maths, vectors
from marlstone.operators import contracts
from marlstone.plans.registry import query
from marlstone.session import table

#: A column of chromosome labels in several spellings, as text both engines read.
LABEL = (
    "CASE p_partkey % 4 WHEN 0 THEN 'chr' WHEN 1 THEN 'CHR' WHEN 2 THEN '' ELSE ' Chr' END || "
    "CASE p_partkey % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'y' WHEN 24 THEN 'mt' ELSE CAST(p_partkey % 25 + 1 AS STRING) END"
)
POS = "CAST(p_partkey * 7919 % 900000 + 1 AS BIGINT)"
CANON = "'chr' || CASE p_partkey % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'M' ELSE CAST(p_partkey % 25 + 1 AS STRING) END"


def loci(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(LABEL).alias("label"), F.expr(POS).alias("pos"), "p_size", "p_retailprice")


@query("pr1_strict_chromosome", f"SELECT p_partkey, {CANON} AS chrom FROM part")
def _(spark, sf_dir):
    return loci(spark, sf_dir).select("p_partkey", coords.strict_chromosome(F.col("label")).alias("chrom"))


@query("pr2_permissive_chromosome", "SELECT n_nationkey, 'chr' || upper(n_name) AS chrom FROM nation")
def _(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", coords.permissive_chromosome(F.concat(F.lit("Chr"), F.lower("n_name"))).alias("chrom"))


@query(
    "pr3_nullable_chromosome",
    """SELECT p_partkey, CASE WHEN p_partkey % 30 BETWEEN 1 AND 22 THEN 'chr' || CAST(p_partkey % 30 AS STRING)
       WHEN p_partkey % 30 = 23 THEN 'chrX' WHEN p_partkey % 30 = 24 THEN 'chrY' END AS chrom FROM part""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", coords.nullable_chromosome(F.expr("'chr' || CAST(p_partkey % 30 AS STRING)")).alias("chrom"))


@query(
    "pr4_coordinate_ids",
    f"""WITH t AS (SELECT p_partkey, CAST(p_partkey % 25 + 1 AS BIGINT) AS code, {POS} AS pos FROM part)
    SELECT p_partkey, code * 1000000000 + pos AS coordinate_id, 'chr' || CASE code WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'M'
    ELSE CAST(code AS STRING) END AS chrom, pos AS position, CAST(-1 AS BIGINT) AS out_of_range FROM t""",
)
def _(spark, sf_dir):
    ids = loci(spark, sf_dir).withColumn("coordinate_id", coords.encode_id(F.col("label"), F.col("pos")))
    return ids.select(
        "p_partkey",
        "coordinate_id",
        coords.decode_chromosome(F.col("coordinate_id")).alias("chrom"),
        coords.decode_position(F.col("coordinate_id")).alias("position"),
        coords.encode_id(F.col("label"), F.col("pos") - 900001).alias("out_of_range"),
    )


@query(
    "pr5_pr6_bins",
    f"""WITH t AS (SELECT p_partkey, {POS} AS pos, {CANON} AS chrom FROM part)
    SELECT p_partkey, pos + 1 AS one_based, (pos - 1) // 10000 AS bin, chrom || ':' || CAST(pos // 1000000 AS STRING) AS block FROM t""",
)
def _(spark, sf_dir):
    pos = F.col("pos")
    chrom = coords.strict_chromosome(F.col("label"))
    return loci(spark, sf_dir).select(
        "p_partkey", coords.to_one_based(pos, 0).alias("one_based"), coords.bin_index(pos, 10_000).alias("bin"), coords.block_label(chrom, pos).alias("block")
    )


@query(
    "pr7_patient_of_barcode",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'TCGA-' || c_mktsegment || '-' || CAST(c_custkey % 97 AS STRING)
       ELSE 'X-' || c_mktsegment || '-' || CAST(c_custkey % 97 AS STRING) || '-01A' END AS patient FROM customer""",
)
def _(spark, sf_dir):
    barcode = F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'TCGA' ELSE 'X' END || '-' || c_mktsegment || '-' || CAST(c_custkey % 97 AS STRING) || '-01A'")
    return table(spark, sf_dir, "customer").select("c_custkey", coords.patient_of(barcode).alias("patient"))


@query(
    "pr9_canonical_pairs",
    """SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS i, greatest(l_partkey, l_suppkey) AS j,
       CASE WHEN l_partkey <= l_suppkey THEN l_quantity ELSE l_extendedprice END AS value_i FROM lineitem""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.least("l_partkey", "l_suppkey").alias("i"),
        F.greatest("l_partkey", "l_suppkey").alias("j"),
        F.when(F.col("l_partkey") <= F.col("l_suppkey"), F.col("l_quantity")).otherwise(F.col("l_extendedprice")).alias("value_i"),
    )


@query(
    "ma1_ma2_logit_sigmoid",
    """WITH t AS (SELECT l_orderkey, l_linenumber, least(greatest(l_discount * 10, 0.001), 0.999) AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(ln(b) - ln(1 - b), 6) AS logit, round(b, 6) AS back FROM t""",
)
def _(spark, sf_dir):
    logit = maths.to_logit(F.col("l_discount") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(logit, 6).alias("logit"), F.round(maths.sigmoid(logit), 6).alias("back"))


@query(
    "ma3_mask_counts",
    "SELECT p_size, least(greatest(CAST(round_even(p_size * 0.25, 0) AS BIGINT), 1), p_size - 1) AS k25, least(greatest(CAST(round_even(p_size * 0.5, 0) AS BIGINT), 1), p_size - 1) AS k50 FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS p_size FROM part)",
)
def _(spark, sf_dir):
    n = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(n.cast("long").alias("p_size")).distinct()
    return rows.select("p_size", maths.mask_count(n, 0.25).alias("k25"), maths.mask_count(n, 0.5).alias("k50"))


@query(
    "ma4_z_score",
    """WITH s AS (SELECT c_mktsegment, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer GROUP BY 1)
    SELECT c_custkey, round((c_acctbal - m) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END, 6) AS z FROM customer JOIN s USING (c_mktsegment)""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    s = c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("sd"))
    sd = F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd"))
    return c.join(s, "c_mktsegment").select("c_custkey", F.round((F.col("c_acctbal") - F.col("m")) / sd, 6).alias("z"))


@query(
    "ma5_log_scales",
    "SELECT l_orderkey, l_linenumber, round(log2(l_quantity + 1), 6) AS activity, round(log10(1 + l_extendedprice), 6) AS bp, CASE WHEN l_tax > 0 THEN round(-log10(l_tax), 6) END AS neg FROM lineitem",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.log2(F.col("l_quantity") + 1), 6).alias("activity"),
        F.round(F.log10(1 + F.col("l_extendedprice")), 6).alias("bp"),
        F.round(maths.neg_log10(F.col("l_tax")), 6).alias("neg"),
    )


@query("ma6_absolute_error", "SELECT l_returnflag, round(avg(abs(l_discount - l_tax)), 6) AS mae FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))), 6).alias("mae"))


@query(
    "ma7_reliability_ceiling",
    """WITH r AS (SELECT l_suppkey, covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0) AS r FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round(2 * r / nullif(1 + r, 0), 6) AS reliability, CASE WHEN r >= 0 THEN round(sqrt(r * r), 6) END AS ceiling FROM r""",
)
def _(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(maths.safe_corr(F.col("l_quantity"), F.col("l_extendedprice")).alias("r"))
    return r.select("l_suppkey", F.round(maths.spearman_brown(F.col("r")), 6).alias("reliability"), F.round(maths.ceiling(F.col("r"), F.col("r")), 6).alias("ceiling"))


@query(
    "ma8_jensen_shannon",
    """WITH c AS (SELECT l_returnflag AS g, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1, 2),
    p AS (SELECT g, k, n / sum(n) OVER (PARTITION BY g) AS p FROM c),
    j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM (SELECT * FROM p WHERE g = 'A') a FULL JOIN (SELECT * FROM p WHERE g = 'R') b ON a.k = b.k)
    SELECT round(sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0)), 6) AS js FROM j""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    both = c.crossJoin(F.broadcast(c.agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))))
    p, q = F.col("a") / F.col("na"), F.col("r") / F.col("nr")
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return both.agg(F.round(F.sqrt(F.greatest(F.sum((part(p) + part(q)) / 2), F.lit(0.0))), 6).alias("js"))


@query(
    "ma9_half_precision_spacing",
    "SELECT p_partkey, pow(2.0, greatest(floor(log2(abs(p_retailprice))), -14) - 10) AS ulp FROM part",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", maths.half_ulp(F.col("p_retailprice")).alias("ulp"))


@query("ma10_adapter_parameters", "SELECT DISTINCT CAST(p_size AS BIGINT) AS d, CAST(2 * p_size + p_size * 64 + 64 + 128 AS BIGINT) AS parameters FROM part")
def _(spark, sf_dir):
    d = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(d.alias("d"), maths.adapter_parameters(d, F.lit(64)).cast("long").alias("parameters")).distinct()


@query(
    "ma11_tail_slope",
    """WITH t AS (SELECT user_id, epoch_us(ts) / 1e9 AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT user_id, round(covar_pop(x, y) / nullif(var_pop(x), 0), 6) AS slope, count(*) AS n FROM t WHERE r <= 10 GROUP BY 1""",
)
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    t = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e9).alias("x"), F.col("value").alias("y"), F.row_number().over(w).alias("r"))
    return t.where("r <= 10").groupBy("user_id").agg(F.round(F.covar_pop("x", "y") / F.nullif(F.var_pop("x"), F.lit(0.0)), 6).alias("slope"), F.count("*").alias("n"))


# ---- strings ---------------------------------------------------------------------------------------------------


@query(
    "st1_slug",
    "SELECT p_partkey, substr(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80) || '_' || substr(sha256(p_name || ' / ' || p_type), 1, 8) AS slug FROM part",
)
def _(spark, sf_dir):
    name = F.concat_ws(" / ", "p_name", "p_type")
    slug = F.substring(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_")), 1, 80)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("_", slug, F.substring(F.sha2(name.cast("binary"), 256), 1, 8)).alias("slug"))


@query(
    "st2_characteristics",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'impression' ELSE trim(regexp_replace(lower(event_type), '[^a-z0-9]+', '_', 'g'), '_') END AS key,
       CAST(user_id AS STRING) AS value FROM events""",
)
def _(spark, sf_dir):
    raw = F.concat(F.col("event_type"), F.lit(": "), F.col("user_id").cast("string"))
    parts = F.split(raw, ":", 2)
    key = F.btrim(F.regexp_replace(F.lower(F.trim(parts[0])), "[^a-z0-9]+", "_"), F.lit("_"))
    alias = F.create_map(*(F.lit(x) for x in ("click", "tap", "view", "impression")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(alias, key), key).alias("key"), F.trim(parts[1]).alias("value"))


@query("st3_number_suffix", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) AS suffix FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).alias("suffix"))


@query("st4_strip_replicates", "SELECT s_suppkey, s_name AS label FROM supplier")
def _(spark, sf_dir):
    name = F.expr("s_name || ', donor' || CAST(s_suppkey % 3 AS STRING) || ', rep' || CAST(s_suppkey % 2 AS STRING)")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace(name, r"(,? *(?:biol_|tech_)?(?:rep|donor)_?[0-9]+)+$", "").alias("label"))


@query("st5_prefix_and_tail", "SELECT page_id, starts_with(url, 'https') AS secure, regexp_extract(url, '([^/]*)$', 1) AS tail FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").startswith("https").alias("secure"), F.substring_index("url", "/", -1).alias("tail"))


@query("st6_metric_family", "SELECT p_type, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'rank' WHEN starts_with(p_type, 'PROMO') THEN 'class' ELSE 'error' END AS family, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, sf_dir):
    t = F.col("p_type")
    family = F.when(t.startswith("STANDARD"), "rank").when(t.startswith("PROMO"), "class").otherwise("error")
    return table(spark, sf_dir, "part").groupBy("p_type", family.alias("family")).agg(F.count("*").alias("n"))


@query("st7_hash_order", "SELECT c_custkey, substr(sha256(CAST(c_custkey AS STRING) || ':17'), 1, 12) AS tie FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.substring(F.sha2(F.concat_ws(":", "c_custkey", F.lit(17)).cast("binary"), 256), 1, 12).alias("tie"))


@query("st8_row_fingerprint", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || CAST(n_regionkey AS STRING) || '}') AS fingerprint FROM nation""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.sha2(F.to_json(F.struct("n_name", "n_regionkey")).cast("binary"), 256).alias("fingerprint"))


@query("st9_json_flatten", "SELECT event_type, 'k' AS key, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    flat = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return flat.where("key = 'k'").groupBy("event_type", "key").agg(F.sum(F.col("value").cast("long")).alias("total"))


@query("st10_lookup_with_default", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("st11_vocabulary_check", "SELECT count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F', 'P')) AS bad_status, count(*) - count(DISTINCT o_orderkey) AS repeated FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.count_if(~F.col("o_orderstatus").isin("O", "F", "P")).alias("bad_status"), (F.count("*") - F.countDistinct("o_orderkey")).alias("repeated")
    )


# ---- arrays ----------------------------------------------------------------------------------------------------

PAIR_SQL = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
COS = "list_inner_product({0}, {1}) / nullif(sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1})), 0)"


def pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    return e.join(b, "vec_id")


@query("ar1_pair_cosine", f"SELECT a.vec_id, round({COS.format('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) AS cosine FROM {PAIR_SQL}")
def _(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query(
    "ar2_centred_similarity",
    f"""WITH m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1),
    x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT vec_id, list(x - m ORDER BY i) AS e FROM x JOIN m USING (i) GROUP BY 1)
    SELECT a.vec_id, round({COS.format('a.e', 'b.e')}, 6) AS centred, round(-list_distance(a.e, b.e), 6) AS negative_distance FROM c a JOIN c b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    means = e.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"))  # as many rows as dimensions
    both = pairs(spark, sf_dir).crossJoin(F.broadcast(mean))
    a, b = vectors.minus(F.col("embedding"), F.col("mean")), vectors.minus(F.col("other"), F.col("mean"))
    both = both.select("vec_id", a.alias("a"), b.alias("b"))
    return both.select(
        "vec_id",
        F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("centred"),
        F.round(vectors.negative_euclidean(F.col("a"), F.col("b")), 6).alias("negative_distance"),
    )


@query(
    "ar4_set_similarity",
    """WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1),
    p AS (SELECT a.l_orderkey, len(list_intersect(a.s, b.s)) AS k, len(a.s) AS x, len(b.s) AS y FROM s a JOIN s b ON b.l_orderkey = a.l_orderkey + 1)
    SELECT l_orderkey, round(k / (x + y - k), 6) AS jaccard, round(k / sqrt(x * y), 6) AS cosine FROM p""",
)
def _(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    p = s.join(s.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("s").alias("t")), "l_orderkey")
    return p.select("l_orderkey", F.round(vectors.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"), F.round(vectors.set_cosine(F.col("s"), F.col("t")), 6).alias("cosine"))


@query("ar5_zero_rows", "SELECT vec_id, count_if(x <> 0) = 0 AS is_zero, count_if(isnan(x) OR isinf(x)) = 0 AS is_finite FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
def _(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.is_zero(e).alias("is_zero"), vectors.is_finite(e).alias("is_finite"))


@query(
    "ar6_paired_pearson",
    """WITH x AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(CASE WHEN var_pop(x) * count(*) > 1e-12 AND var_pop(y) * count(*) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) AS pearson FROM x GROUP BY 1""",
)
def _(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", F.round(vectors.paired_pearson(F.col("embedding"), F.col("other")), 6).alias("pearson"))


@query(
    "ar7_paired_spearman",
    """WITH x AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    r AS (SELECT vec_id, rank() OVER (PARTITION BY vec_id ORDER BY x) + (count(*) OVER (PARTITION BY vec_id, x) - 1) / 2 AS p, rank() OVER (PARTITION BY vec_id ORDER BY y) + (count(*) OVER (PARTITION BY vec_id, y) - 1) / 2 AS q FROM x)
    SELECT vec_id, round(covar_pop(p, q) / nullif(stddev_pop(p) * stddev_pop(q), 0), 6) AS spearman FROM r GROUP BY 1""",
)
def _(spark, sf_dir):
    x = pairs(spark, sf_dir).select("vec_id", F.inline(F.arrays_zip(F.col("embedding").alias("x"), F.col("other").alias("y"))))
    rank = lambda c: F.rank().over(Window.partitionBy("vec_id").orderBy(c)) + (F.count("*").over(Window.partitionBy("vec_id", c)) - 1) / 2
    r = x.toDF("vec_id", "x", "y").select("vec_id", rank("x").alias("p"), rank("y").alias("q"))
    return r.groupBy("vec_id").agg(F.round(maths.safe_corr(F.col("p"), F.col("q")), 6).alias("spearman"))


@query("ar9_argmax", "SELECT vec_id, CAST(list_position(embedding[1:4], list_max(embedding[1:4])) AS INTEGER) AS first_four, CAST(list_position(embedding[5:8], list_max(embedding[5:8])) AS INTEGER) AS next_four FROM embeddings")
def _(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.argmax(F.slice(e, 1, 4)).alias("first_four"), vectors.argmax(F.slice(e, 5, 4)).alias("next_four"))


@query("ar10_ar13_pad_and_pool", "SELECT vec_id, CAST(len(embedding) + greatest(256 - len(embedding), 0) AS INTEGER) AS width, round(list_avg(embedding::DOUBLE[]), 6) AS pooled FROM embeddings")
def _(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(vectors.padded(e, 256)).alias("width"), F.round(vectors.total(e) / F.size(e), 6).alias("pooled"))


@query("ar12_long_form", "SELECT i, count(*) AS n, round(avg(x), 6) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i FROM embeddings) GROUP BY 1")
def _(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    return x.groupBy("i").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


# ---- set operations --------------------------------------------------------------------------------------------


@query("so1_union_with_source", "SELECT DISTINCT c_nationkey AS nation, 'customer' AS origin FROM customer UNION ALL SELECT DISTINCT s_nationkey, 'supplier' FROM supplier")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("origin"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("origin"))).dropDuplicates()


@query("so2_so3_intersect_except", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS shared FROM part")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return p.join(big, "p_partkey", "left_semi").withColumn("shared", F.lit(True)).unionByName(p.join(big, "p_partkey", "left_anti").withColumn("shared", F.lit(False)))


@query("so4_disjoint", "SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return contracts.require_disjoint(c.where("c_acctbal < 0").select("c_custkey"), c.where("c_acctbal >= 0").select("c_custkey"), "c_custkey")


@query(
    "so5_three_way_partition",
    "SELECT CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN CASE WHEN c_acctbal > 0 THEN 'all' ELSE 'shared' END ELSE 'external' END AS part, count(*) AS n FROM customer GROUP BY 1",
)
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.lit(True).alias("seen")).distinct()
    c = table(spark, sf_dir, "customer").join(s, "c_nationkey", "left")
    part = F.when(F.col("seen"), F.when(F.col("c_acctbal") > 0, "all").otherwise("shared")).otherwise("external")
    return c.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("so6_so7_union_of_ids", "SELECT DISTINCT k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_discount = 0 UNION SELECT p_partkey FROM part WHERE p_size = 1)")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_discount = 0").select(F.col("l_partkey").alias("k"))
    return a.union(table(spark, sf_dir, "part").where("p_size = 1").select("p_partkey")).distinct()


@query("so8_alias_of_first", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS alias_of FROM part")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return p.join(p.groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("alias_of")), ["p_brand", "p_type", "p_size"]).select("p_partkey", "alias_of")


@query("so9_combinations", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    return n.select("n_regionkey", F.col("n_name").alias("a")).join(n.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey").where("a < b").select("a", "b")
