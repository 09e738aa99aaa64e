"""Exact dedup, vector codes and whitening against plain versions."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest

from marlstone.llm import exact_dedup, vector_codes, vectors, whitening

DOCS = "doc_id long, text string, row string, key int, bucket int, owner int"  # extra columns clash with the operator's own


def plain_groups(docs):
    """(doc_id, keep_id, size, digest) of each row, and how many rows of each (id, text) are kept."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in docs]
    groups = defaultdict(list)
    for (d, _), t in zip(docs, norm):
        groups[t].append(d)
    keep = {t: min((d for d in g if d is not None), default=None) for t, g in groups.items()}
    rows = [(d, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (d, _), t in zip(docs, norm)]
    return rows, {(keep[t], t) for t in groups}


def check_groups(spark, docs, **how):
    df = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in docs], DOCS).repartition(5)
    got = exact_dedup.exact_groups(df, **how).collect()
    want, kept = plain_groups(docs)
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    stay = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(stay, key=key) == sorted([(k, hashlib.sha256(t.encode()).hexdigest()) for k, t in kept], key=key)


EDGES = [(5, "a  b"), (3, "a\t\n b"), (9, "a b"), (9, "a b"), (3, "a b"), (7, None), (8, ""), (None, ""), (None, "z"), (None, "z"), (11, " "), (12, "\x0b\x0c"), (13, "a b"), (14, "A b"), (15, "x" * 300_000), (16, "x" * 300_000), (17, "x" * 299_999)]


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_exact_groups_match_plain_ones_whatever_collides(spark, bits):
    rng = np.random.default_rng(bits)
    docs = EDGES + [(int(i), f"text {rng.integers(40)}") for i in rng.integers(100, 400, 300)]
    check_groups(spark, docs, key_bits=bits, capacity=4)


def test_exact_groups_of_a_hot_text_and_of_nothing(spark):
    check_groups(spark, [(i, "same" if i % 3 else f"other {i}") for i in range(900)], capacity=16)
    check_groups(spark, [])


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id) AS key", "1L AS held")
    cells, depth = exact_dedup.directory(keys, 3000, 8, capacity=50)
    at = keys.selectExpr(f"shiftrightunsigned(key, {64 - depth}) AS cell").join(cells, "cell").groupBy("bucket", "owner").count().collect()
    assert sum(r["count"] for r in at) == 3000 and max(r["count"] for r in at) <= 50
    assert len({r.bucket for r in at}) == len(at)  # a bucket has one owner
    held = {r.bucket: r["count"] for r in at}
    for b in held:  # a bucket and its sibling's leaves together were too many, or it would not have split
        sibling = sum(n for o, n in held.items() if any(o >> s == b ^ 1 for s in range(20)))
        assert b == 1 or held[b] + sibling > 50
    load = defaultdict(int)
    for r in at:
        load[r.owner] += r["count"]
    assert set(load) <= set(range(8)) and max(load.values()) <= 3000 / 8 + 100


def lloyd(vecs, parts=8, entries=16, rounds=6, scale=4096):
    """Plain rounds; vecs sorted by id."""
    x = np.floor(np.asarray(vecs, np.float64) * scale).astype(np.int64).reshape(len(vecs), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x[:, :, None] - books[None]) ** 2).sum(-1)
        a = d.argmin(-1)
        if r == rounds:
            return a, d.min(-1).sum(-1), books
        for p in range(parts):
            for k in range(books.shape[1]):
                if (a[:, p] == k).any():
                    books[p, k] = np.floor_divide(x[a[:, p] == k, p].sum(0), (a[:, p] == k).sum())


VECS = "vec_id long, embedding array<float>, label int, x int, entry string"


@pytest.mark.parametrize("kind", ["normal", "ties", "few", "clusters"])
def test_codes_are_those_of_plain_rounds(spark, kind):
    rng = np.random.default_rng(5)
    n = 9 if kind == "few" else 400
    v = rng.normal(size=(n, 16)).astype(np.float32)
    if kind == "ties":
        v = (rng.integers(-2, 3, size=(n, 16)) / 4096).astype(np.float32)  # whole numbers -2..2: many equal distances
    if kind == "clusters":
        v = (rng.normal(size=(12, 16))[rng.integers(12, size=n)] + 0.01 * rng.normal(size=(n, 16))).astype(np.float32)
    labels = [int(c) if c else None for c in rng.integers(0, 4, n)]
    bad = [(n, None, 1, 0, ""), (n + 1, [1.0] * 15 + [None], 1, 0, ""), (n + 2, [1.0] * 15 + [math.nan], 1, 0, ""), (n + 3, [math.inf] * 16, 1, 0, ""), (-1, [], 1, 0, "")]
    df = spark.createDataFrame([(i, v[i].tolist(), labels[i], 0, "") for i in range(n)] + bad, VECS).repartition(3)
    coded, books = vector_codes.compress(df)
    got = {r.vec_id: r for r in vector_codes.code_report(coded, books).collect()}
    codes, errors, want = lloyd(v)
    assert (books == want).all() and len(got) == n
    total = defaultdict(int)
    for c, e in zip(labels, errors):
        total[c] += int(e)
    for i in range(n):
        assert got[i].code == "".join(f"{c:02x}" for c in codes[i]) and got[i].error == errors[i] and got[i].label_error == total[labels[i]]
    assert got[0].codebooks_sha256 == hashlib.sha256(",".join(str(c) for c in want.ravel()).encode()).hexdigest()


def test_elkan_passes_over_entries_and_keeps_plain_results():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, size=(16, 8))
    x = (centres[rng.integers(16, size=2000)] + rng.integers(-60, 60, size=(2000, 8))).astype(np.int64)
    book = x[:16].copy()
    entry, upper, lower = vector_codes.started(x, book)
    computed = 0
    for _ in range(6):
        new = np.stack([x[entry == k].sum(0) // max(1, (entry == k).sum()) if (entry == k).any() else book[k] for k in range(16)])
        moved = np.sqrt(((new - book) ** 2).sum(1).astype(float)) * (1 + vector_codes.SLACK)
        book = new
        computed += vector_codes.elkan(x, book, entry, upper, lower, moved)
        d = ((x[:, None] - book[None]) ** 2).sum(-1)
        assert (entry == d.argmin(1)).all()
        assert (upper.astype(float) >= np.sqrt(d[np.arange(2000), entry])).all() and (lower.astype(float) <= np.sqrt(d)).all()
    assert computed < 0.35 * 6 * 2000 * 16


def test_vectors_refused(spark):
    df = lambda *v: spark.createDataFrame([(i, x, 1, 0, "") for i, x in enumerate(v)], VECS)
    with pytest.raises(ValueError, match="unequal"):
        vector_codes.compress(df([1.0] * 8, [1.0] * 16))
    with pytest.raises(ValueError, match="divide"):
        vector_codes.compress(df([1.0] * 9))
    with pytest.raises(Exception, match="beyond 32 bits"):
        vector_codes.compress(df([1e30] * 8))
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(df([3e5] * 8, [0.0] * 8))
    coded, books = vector_codes.compress(df())
    assert vector_codes.code_report(coded, books).count() == 0 == books.size
    assert whitening.whiten(df()).count() == 0


def plain_whitening(v, scale=256):
    x = np.floor(np.asarray(v, np.float64) * scale).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return x, n, s, e, u


@pytest.mark.parametrize("shape", [(300, 40), (300, 6), (200, 70), (3, 5)])
def test_whitening_equals_a_dense_one(spark, shape):
    rng = np.random.default_rng(shape[1])
    v = (rng.normal(size=shape) * np.linspace(1, 0.3, shape[1])).astype(np.float32)
    v = np.vstack([v, v[:1], v[:1]])  # copies count once in the fit, and have their own rows
    df = spark.createDataFrame([(i, r.tolist(), 1, 0, "") for i, r in enumerate(v)] + [(999, None, 1, 0, ""), (998, [math.nan] * shape[1], 1, 0, "")], VECS).repartition(3)
    got = defaultdict(dict)
    for r in whitening.whiten(df).collect():
        got[r.component][r.vec_id] = r
    x, n, s, e, u = plain_whitening(v)
    k = min(4, int((e > 1e-12 * e.sum()).sum()))
    assert sorted(got) == list(range(1, k + 1))
    for j in range(k):
        z = (x - s / n) @ u[:, j] / math.sqrt(e[j])
        mine = np.array([got[j + 1][i].whitened for i in range(len(v))])
        assert min(np.abs(mine - z).max(), np.abs(mine + z).max()) < 1e-9
        for i in (0, len(v) - 1):
            r = got[j + 1][i]
            assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
            assert abs(r.explained - e[j] / e.sum()) < 1e-10 and r.identity_error < 1e-9


def test_whitening_of_equal_and_of_far_vectors(spark):
    equal = spark.createDataFrame([(i, [1.0, 2.0], 1, 0, "") for i in range(5)], VECS)
    assert whitening.whiten(equal).count() == 0
    far = spark.createDataFrame([(0, [4e6, 0.0], 1, 0, ""), (1, [-4e6, 0.0], 1, 0, ""), (2, [0.0, 0.0], 1, 0, "")], VECS)
    rows = {r.vec_id: r for r in whitening.whiten(far).collect()}
    assert rows[0].deviation is None and rows[2].deviation == 0 and abs(rows[0].whitened) == pytest.approx(math.sqrt(1.5))


def test_sums_over_many_tasks_go_in_two_levels(spark):
    df = spark.range(500).repartition(90).selectExpr("array(cast(id as float), 1f) AS embedding", "id AS vec_id")
    x = vectors.quantised(df, 2)
    assert vectors.summed(x, lambda m: m.sum(axis=0, dtype=np.int64), (2,), "i8").tolist() == [500 * 499, 1000]
