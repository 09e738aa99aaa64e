"""Vector code compression: product codes by Elkan's form of Lloyd's rounds.

Each part of a vector keeps its entry, an upper bound of its distance to it and a lower bound to every entry, written
with the rows between rounds. An entry is passed over only where a strict inequality proves it farther; what is left is
compared by exact whole-number distances, ties to the lower index. Bounds are rounded outwards, so codes are those of
plain Lloyd rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch
from marlstone.llm.vectors import binary, matrix, quantised, summed, width

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Label sums are broadcast up to so many labels; beyond, they are joined by label.
LABELS = 100_000
#: Relative slack for a square root and two roundings of doubles.
SLACK = 4e-15


def up(v: np.ndarray) -> np.ndarray:
    """v as 32-bit floats, never below."""
    y = (v * (1 + SLACK)).astype(np.float32)
    return np.where(y < v, np.nextafter(y, np.float32(np.inf)), y)


def down(v: np.ndarray) -> np.ndarray:
    """v (not negative) as 16-bit floats, never above."""
    v = np.maximum(v * (1 - SLACK), 0)
    y = np.minimum(v, 65504.0).astype(np.float16)
    return np.where(y > v, np.nextafter(y, np.float16(0)), y)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("...i,...i->...", d, d)


def elkan(x: np.ndarray, book: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> int:
    """One assignment of a part in place: entry, upper and lower of the round before, moved by what each entry has moved.

    Returns how many exact distances were computed.
    """
    n, k = lower.shape
    if not n:
        return 0
    upper[:] = up(upper.astype(np.float64) + moved[entry])
    lower[:] = down(lower.astype(np.float64) - moved)
    between = np.sqrt(squares(book[:, None].astype(np.float64), book[None])) * (0.5 * (1 - SLACK))
    np.fill_diagonal(between, np.inf)
    open_ = np.flatnonzero(~(upper < between.min(axis=1)[entry]))
    if not len(open_):
        return 0
    a, y = entry[open_].astype(np.int64), x[open_]
    best = squares(y, book[a])
    near, low = np.sqrt(best.astype(np.float64)) * (1 + SLACK), lower[open_].astype(np.float64)
    low[np.arange(len(a)), a] = np.sqrt(best.astype(np.float64))
    done = len(a)
    for c in range(k):
        ask = np.flatnonzero((a != c) & ~(near < low[:, c]) & ~(near < between[a, c]))
        if not len(ask):
            continue
        d = squares(y[ask], book[c])
        done += len(ask)
        low[ask, c] = np.sqrt(d.astype(np.float64))
        better = (d < best[ask]) | ((d == best[ask]) & (c < a[ask]))
        won = ask[better]
        a[won], best[won] = c, d[better]
        near[won] = low[won, c] * (1 + SLACK)
    entry[open_], upper[open_], lower[open_] = a, up(near), down(low)
    return done


def started(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first assignment: every distance."""
    d = squares(x[:, None], book[None])
    entry = d.argmin(axis=1)
    root = np.sqrt(d.astype(np.float64))
    return entry.astype(np.uint8), up(root[np.arange(len(x)), entry]), down(root)


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, keep: tuple[str, ...], last: bool) -> DataFrame:
    """rows with entry, upper and lower by the given codebooks; instead of bounds with the error if last."""
    parts, k, w = books.shape
    state = ("x",) if moved is None else ("x", "entry", "upper", "lower")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = "entry binary, error long" if last else "x binary, entry binary, upper binary, lower binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            col = lambda c, t: matrix(b.column(b.schema.get_field_index(c)), t)
            raw = col("x", "<i4")
            x = raw.astype(np.int64).reshape(n, parts, w)
            if moved is None:
                got = [started(x[:, p], books[p]) for p in range(parts)]
                entry, upper, lower = (np.stack(v, axis=1) for v in zip(*got))
            else:
                entry, upper, lower = col("entry", "u1").copy(), col("upper", "<f4").copy(), col("lower", "<f2").reshape(n, parts, k).copy()
                for p in range(parts):
                    e, u, l = entry[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()  # noqa: E741
                    elkan(x[:, p], books[p], e, u, l, moved[p])
                    entry[:, p], upper[:, p], lower[:, p] = e, u, l
            whole = lambda v: binary(np.ascontiguousarray(v), np.arange(1, n + 1) * (v.nbytes // n))
            kept = [b.column(b.schema.get_field_index(c)) for c in keep]
            if last:
                error = sum(squares(x[:, p], books[p][entry[:, p]]) for p in range(parts))
                yield pa.RecordBatch.from_arrays([*kept, whole(entry), pa.array(error)], [*keep, "entry", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*kept, whole(raw), whole(entry), whole(upper), whole(lower)], [*keep, "x", "entry", "upper", "lower"])

    return rows.select(*keep, *state).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + out)


def renewed(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with each used entry replaced by the floor of its parts' mean, from exact sums."""
    parts, k, w = books.shape

    def part(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        out = np.zeros((parts, k, w + 1), np.int64)
        y = x.reshape(len(x), parts, w).astype(np.int64)
        for p in range(parts):
            np.add.at(out[p, :, :w], entry[:, p], y[:, p])
            out[p, :, w] = np.bincount(entry[:, p], minlength=k)
        return out

    sums = summed(rows, part, (parts, k, w + 1), "i8", ("x", "entry"))
    count = sums[:, :, w:]
    return np.where(count > 0, sums[:, :, :w] // np.maximum(count, 1), books)


def compress(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(rows of vec_id, label, entry (a byte a part), error; final codebooks as parts x entries x width).

    Rows with a null or empty vector, or a null or non-finite component, go. The first codebook is that of the least ids,
    null ids last, equal ids by their vectors; with fewer rows than entries it has as many entries as there are rows.
    A length that parts don't divide, unequal lengths and components of which squared distances could pass 64 bits are
    errors. An empty table gives no rows and no entries. Other columns of df are never read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    keep = ("vec_id", "label")
    picked = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding"))
    rows = scratch.table(quantised(picked, scale, keep=("label",)))
    d = width(rows)
    if d % parts:
        raise ValueError(f"{parts} parts don't divide {d} components")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if not first:
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, entry binary, error long"), np.zeros((parts, 0, 0), np.int64)
    most = int(summed(rows, lambda x: np.array([np.abs(x.astype(np.int64)).max() >= (1 << 62) ** 0.5 / (2 * d**0.5)]), (1,), "i8")[0])
    if most:
        raise ValueError("components are too large for 64-bit squared distances")
    books = np.stack([np.frombuffer(r.x, "<i4").astype(np.int64).reshape(parts, d // parts) for r in first], axis=1)
    moved = None
    for _ in range(rounds):
        new = scratch.table(assigned(rows, books, moved, keep, last=False))
        scratch.drop(rows)
        rows = new
        after = renewed(rows, books)
        moved = np.sqrt(squares(after.astype(np.float64), books)) * (1 + SLACK)
        books = after
    out = scratch.table(assigned(rows, books, moved, keep, last=True))
    scratch.drop(rows)
    return out, books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); rows without a label share one sum."""
    scratch = Scratch(coded.sparkSession)
    sums = scratch.table(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_label")
    if sums.count() <= LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("entry")).alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")
    )


def _sql() -> str:
    """Plain Lloyd rounds, every distance of every round."""
    away = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    text = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    p AS (SELECT vec_id, part, q[part * (len(q) // {PARTS}) + 1 : (part + 1) * (len(q) // {PARTS})] AS x FROM v, range({PARTS}) t(part)),
    c0 AS (SELECT part, entry, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) f USING (vec_id) WHERE entry < {ENTRIES})"""
    for r in range(ROUNDS + 1):
        text += f""",
    d{r} AS MATERIALIZED (SELECT vec_id, part, entry, {away} AS d FROM p JOIN c{r} USING (part)),
    a{r} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""
        if r < ROUNDS:
            text += f""",
    s{r} AS (SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN p USING (vec_id, part), range(1, 1 + (SELECT max(len(x)) FROM p)) t(i) GROUP BY ALL),
    m{r} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY ALL),
    c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (part, entry))"""
    return (
        text
        + f""",
    e AS (SELECT vec_id, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h"""
    )


REPORT_SQL = _sql()
