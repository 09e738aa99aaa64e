"""Operators over the whole corpus, and the pipeline, against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import signature_join, suffix_dedup
from marlstone.llm import queries as registered
from marlstone.llm.common import Scratch
from marlstone.llm.components import connected_components


def sha(b):
    return hashlib.sha256(b).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("doc", F.lit(1)).withColumn("key", F.lit("k")).withColumn("bits", F.lit(None).cast("int"))


def brute_repeats(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), sha(bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeated_bytes(spark, hot):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(50, 900))) for _ in range(30)]
    rows = []
    for i in range(120):
        t = ""
        for _ in range(rng.randint(1, 5)):
            x = rng.choice(base)
            a = rng.randint(0, len(x) - 1)
            t += x[a : a + rng.randint(20, 400)] + "".join(rng.choice("xyz") for _ in range(rng.choice([0, 0, 7])))
        rows.append((i, t))
    rows += [(1000, None), (1001, ""), (1002, "a" * 500), (1003, "a" * 99), (1004, "ab" * 300), (1005, rows[0][1]), (1006, "a" * 101)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(frame(spark, rows), hot_classes=hot).collect()}
    assert got == brute_repeats(rows)


def test_repeated_rows_and_null_ids(spark):
    t = "".join(random.Random(1).choices("abcdefgh", k=300))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix_dedup.removal_report(frame(spark, [(5, t), (5, t), (None, t[:150])])).collect())
    assert got == [(False, 5, 150), (False, 5, 150), (True, 0, 0)]
    assert suffix_dedup.removal_report(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_rows_of_one_id_with_unlike_texts_are_documents_of_their_own(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefgh", k=n))
    a, b, c = text(400), text(500), text(300)
    rows = [(1, a), (9, a[:200] + text(150)), (9, b), (None, c), (None, c + a[:150]), (None, text(200)), (12, b[:250]), (12, b[:250]), ((1 << 63) - 1, b[100:300])]
    # the same documents with plain numbers in the defined order: by id (null first), then by the text's digest
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, sha(r[1].encode())))
    want = brute_repeats([(i, t) for i, (_, t) in enumerate(order)])
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(frame(spark, rows)).collect())
    assert got == sorted((d is not None, d or 0, *want[order.index((d, t))]) for d, t in rows)
    fresh = [g for g in got if g[1] == 9 and g[2] == 500]
    assert len(fresh) == 1 and fresh[0][3] == 0  # b is new, whatever the other row of its id repeats


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start, group = rng.integers(0, 3800, 500), rng.integers(0, 7, 500)
    order, common = suffix_dedup.suffix_sort(data, start, group)
    keys = [(group[i], bytes(data[start[i] : start[i] + 100])) for i in order]
    assert keys == sorted(keys)
    for i in range(1, len(order)):
        if group[order[i]] == group[order[i - 1]]:
            a, b = keys[i - 1][1], keys[i][1]
            assert common[i] == next((k for k in range(100) if a[k] != b[k]), 100)


def brute_components(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = {}
    for d, t in rows:
        w = word.findall(low(t or ""))
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("cell_tokens,near", [(4_000_000, 8192), (300, 4)])
def test_jaccard_components(spark, cell_tokens, near):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocab) for _ in range(40)] for _ in range(6)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 150))]
        if rng.random() < 0.6:
            base[len(base) // 2 : len(base) // 2] = rng.choice(passages)
        for _ in range(rng.randint(1, 7)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "A b"), (903, "a B"), (904, " \t"), (905, "one")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.components_report(frame(spark, rows), cell_tokens=cell_tokens, near=near).collect()}
    assert got == brute_components(rows)


def test_unlike_texts_with_a_common_passage_are_no_family(spark, monkeypatch):
    """More classes under a head than a cell takes: their texts don't travel, for no two of them may link."""
    rng, links, held = random.Random(3), signature_join.family_links, []
    rows = []
    for p in range(6):
        passage = [f"p{p}x{i}" for i in range(12)]
        rows += [(10 * p + k, " ".join([f"c{rng.randrange(40)}" for _ in range(60)] + passage)) for k in range(7)]

    def seen(members, families, *rest):
        held.append(families.count())
        return links(members, families, *rest)

    monkeypatch.setattr(signature_join, "family_links", seen)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.components_report(frame(spark, rows), cell_tokens=300, near=4).collect()}
    assert got == brute_components(rows) and held == [0]


def test_texts_of_common_words_do_not_meet_by_chance(spark, monkeypatch):
    rng, edges, held = random.Random(4), signature_join.near_edges, []
    rows = [(d, " ".join([f"c{rng.randrange(12)}" for _ in range(200)] + [f"d{d}x{i}" for i in range(40)])) for d in range(40)]

    def seen(met, per_cent):
        held.append(met.count())
        return edges(met, per_cent)

    monkeypatch.setattr(signature_join, "near_edges", seen)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.components_report(frame(spark, rows)).collect()}
    assert got == brute_components(rows) and held == [0]


def test_any_two_classes_of_a_crowd_that_may_link_share_a_cell(spark):
    rng = random.Random(6)
    rows = [(h, 1000 * h + u, rng.choice([1, 2, 17, 20, 85, 100, rng.randint(1, 400)])) for h in (1, 2) for u in range(250)]
    got = signature_join.crowd_cells(spark.createDataFrame(rows, "head long, uid long, n long"), 85, 32).collect()
    cells = {}
    for r in got:
        cells.setdefault(r.head, set()).add(r.uid)
    met = {frozenset((a, b)) for c in cells.values() for a in c for b in c}
    assert all(frozenset((u, v)) in met for h, u, n in rows for g, v, m in rows if h == g and 100 * n >= 85 * m and 100 * m >= 85 * n and u != v)
    assert max(map(len, cells.values())) <= 64 and all(len({u // 1000 for u in c}) == 1 for c in cells.values())


def test_strays_meet_the_members_of_other_parts(spark, monkeypatch):
    """A path of links through one family that is dealt into parts, with joins that leave rows dealt by cell."""
    monkeypatch.setattr(signature_join, "ANCHORS", 4)
    rng = np.random.default_rng(2)
    token = rng.integers(0, 1 << 62, 700).astype(np.uint64)
    rows = [(i, 0, 100, np.sort(token[5 * i : 5 * i + 100]).tobytes()) for i in range(120)]
    members = spark.createDataFrame(rows, "uid long, label long, n long, tokens binary").repartition(4)
    families = members.select("uid", F.col("label").alias("family"), "n")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = signature_join.family_links(members, families, Scratch(spark), 85, 3000)
        assert "REPARTITION_BY_NUM" in links._jdf.queryExecution().executedPlan().toString()  # the cells are dealt anew
        got = {r.node: r.component for r in connected_components(links).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(120)}


def test_jaccard_edges(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in signature_join.components_report(frame(spark, [(None, "a b c d e"), (4, "x y z"), (4, "x y z"), (9, "x y z")])).collect())
    assert got == [(False, 4, 1, 4), (False, 4, 1, 4), (False, 9, 1, 4), (True, 0, 2, None)]
    assert signature_join.components_report(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_dual_traversal_loses_no_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 200)).astype(np.uint64)) for _ in range(40)]
    for s in list(sets):
        for _ in range(4):
            keep = rng.random(len(s)) > rng.choice([0.02, 0.08, 0.2])
            sets.append(np.unique(np.append(s[keep], rng.integers(0, 1 << 63, rng.integers(0, 4)).astype(np.uint64))))
    n = np.array([len(s) for s in sets])
    linked = lambda a, b: 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (n[a] + n[b] - k) and k > 0
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = [np.sort(c) for c in np.split(codes, np.cumsum(n)[:-1])]
    root = signature_join.tree(np.arange(len(sets)), n, own, codes.max() + 1)
    met = {frozenset(map(id, p)) for p in signature_join.traverse(root, root, 85)}
    leaves, todo = [], [root]
    while todo:
        x = todo.pop()
        todo += x.below
        leaves += [x] * (x.members is not None)
    home = {int(i): id(x) for x in leaves for i in x.members}
    assert all(frozenset((home[i], home[j])) in met for i in range(len(sets)) for j in range(i) if linked(i, j))
    assert len(met) < len(leaves) * (len(leaves) + 1) / 2


def brute_sets(sets):
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if k and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(6))
def test_cells_near_the_threshold(seed):
    """Families whose pairs lie just below and just above the threshold, with tokens that agree in all but their low bits."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 63).astype(np.uint64)
    sets = []
    for _ in range(70):
        lost = rng.choice(63, rng.integers(0, 6), replace=False)
        s = np.delete(base, lost)
        s = np.append(s, base[rng.choice(63, rng.integers(0, 3), replace=False)] ^ np.uint64(1))  # another token, equal above
        sets.append(np.unique(np.append(s, rng.integers(0, 1 << 62, rng.integers(0, 5)).astype(np.uint64))))
    want = brute_sets(sets)
    for p in (range(70), rng.permutation(70)):
        p = np.array(list(p))
        got = signature_join.cell_links([sets[i] for i in p], p.astype(np.int64), None, 85)
        assert got.tolist() == [want[i] for i in p]
    # two sides: only pairs across count
    got = signature_join.cell_links(sets, np.arange(70), 30, 85)
    for i in range(30):
        for j in range(30, 70):
            k = len(np.intersect1d(sets[i], sets[j]))
            assert got[i] == got[j] or not 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k)
    # sketches never part a link
    m, n = len(sets), np.array([len(s) for s in sets])
    data, cuts = signature_join.parity_sketches(np.repeat(np.arange(m), n), np.concatenate(sets), n)
    root = signature_join.near_roots(n, [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], 85)
    assert all(root[i] == root[want[i]] for i in range(m))


def test_collision_triples_stay_together(spark):
    """a-b just misses, a-c and b-c link, in every order of ids: no component depends on the order of traversal."""
    base = [f"b{i}" for i in range(63)]
    rows, want = [], {}
    for k in range(12):
        own = [[f"{k}{x}{i}" for i in range(6)] for x in "ab"]
        a, b, c = base[:60] + own[0], base[:60] + own[1], base + own[0][:1]
        ids = [3 * k, 3 * k + 1, 3 * k + 2]
        random.Random(k).shuffle(ids)
        rows += [(i, " ".join(f"{k}_{w}" for w in t)) for i, t in zip(ids, (a, b, c))]
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) < len(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.components_report(frame(spark, rows)).collect()}
    assert got == want


def test_jaccard_of_long_texts_text_ids_and_repeats(spark):
    long = " ".join(f"w{i % 9973}" for i in range(40_000))
    rows = [("b", long), ("a", long + " more"), ("c", "x y z"), ("c", "p q r s"), ("d", "p q r s"), (None, "p q r s t"), (None, "other words here now"), ("e", None)]
    df = spark.createDataFrame(rows * 2, "name string, body string").withColumn("text", F.lit("n")).withColumn("uid", F.lit(1)).withColumn("key", F.lit(2))
    got = sorted({(r.doc_id or "", r.n_shingles, r.component_id) for r in signature_join.components_report(df, "name", "body").collect()})
    one, more = 9973, 9974
    assert got == [("", 1, None), ("", 2, None), ("a", more, "a"), ("b", one, "a"), ("c", 1, "c"), ("d", 1, "c"), ("e", 0, "e")]


def test_one_of_a_group_stays(spark):
    df = frame(spark, [(None, "p q r s"), (None, "u v w x"), (4, "u v w x"), (5, "a b"), (6, "a b"), (6, "a b"), (7, None), (8, ""), (9, "k l m")])
    kept = signature_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, "p q r s"), (None, "u v w x"), (5, "a b"), (7, None), (8, ""), (9, "k l m")], key=str)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_registered_queries(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registered.op5_signature_tree_join(spark, sf).collect()}
    assert len(got) == n and got == brute_components(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registered.op6_suffix_dedup(spark, sf).collect()}
    assert got == brute_repeats(docs)


def test_pipeline_stages(spark, sf):
    """Each stage against its brute-force version on what its predecessor kept."""
    from tests_helpers import brute_windows

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    first = corpus_pipeline.language_id(spark, docs, sf).cache()
    assert first.columns == columns and set(rows(first)) == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    second = corpus_pipeline.near_duplicates(spark, first, sf).cache()
    components = brute_components([(r.doc_id, r.text) for r in first.collect()])
    assert second.columns == columns and set(rows(second)) == {d for d, (_, c) in components.items() if c == d}
    third = corpus_pipeline.decontamination(spark, second, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = brute_windows([(r.doc_id, r.text) for r in second.collect()], items)
    assert third.columns == columns and set(rows(third)) == {d for d, x in dirty.items() if not x[4]}
    fourth = corpus_pipeline.secret_scan(spark, third, sf).cache()
    assert fourth.columns == columns and set(rows(fourth)) == set(rows(third))
    assert not any("AKIA" in r.text or re.search("[0-9a-f]{32}", r.text) for r in fourth.collect())
    last = rows(corpus_pipeline.tokenize(spark, fourth, sf))
    assert {d: r.decoded_sha256 for d, r in last.items()} == {d: sha(r.text.encode()) for d, r in rows(fourth).items()}
    assert {d: r.ids_sha256 for d, r in rows(corpus_pipeline.run(spark, sf)).items()} == {d: r.ids_sha256 for d, r in last.items()}
