"""Probes, compressors and imputers from sums over rows: tasks send fixed-size sums, the driver solves d x d systems.

Widths (features, targets) and the number of folds or groups are the caller's and small; rows aren't bounded. Rows with a
null vector, target or fold take no part. Vectors of one column have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64  # first of the two levels on which the tasks' sums are added


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """key -> sum of v over parts (key, bucket, v): by key and bucket first, so no task holds the sums of all tasks."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf.v.to_list()), axis=0)
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "bucket": [pdf.bucket.iloc[0]], "v": [total]})

    schema = "key int, bucket int, v array<double>"
    some = parts.groupBy("key", "bucket").applyInPandas(add, schema)
    return {r.key: np.array(r.v) for r in some.groupBy("key").applyInPandas(add, schema).collect()}


def bucket() -> int:
    return TaskContext.get().partitionId() % BUCKETS


@dataclass
class Sums:
    """X'X and X'Y with a last column of ones in X, and the sums of squares of Y."""

    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.xx + other.xx, self.xy + other.xy, self.yy + other.yy)

    @property
    def n(self) -> float:
        return float(self.xx[-1, -1])

    def sd(self) -> np.ndarray:
        """Population deviation of each feature; one for a constant feature."""
        mean = self.xx[-1, :-1] / self.n
        var = np.diag(self.xx)[:-1] / self.n - mean * mean
        return np.where(var > 1e-14 * np.maximum(mean * mean, 1e-300), np.sqrt(np.maximum(var, 0)), 1.0)

    def ridge(self, alpha: float, sd: np.ndarray | None = None) -> np.ndarray:
        """Coefficients (features and intercept, by target) on features divided by sd, told for the plain features."""
        scale = self.sd() if sd is None else sd
        return np.linalg.solve(self.xx + np.diag([*(alpha * scale * scale), 0.0]), self.xy)

    def sse(self, b: np.ndarray) -> np.ndarray:
        return np.maximum(self.yy - 2 * (b * self.xy).sum(0) + (b * (self.xx @ b)).sum(0), 0)



def sums(df: DataFrame, x: str, y: str, key: str) -> dict[int, Sums]:
    """key -> Sums of array columns x and y; one pass."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, g in pdf.groupby("key"):
                a = np.column_stack([np.stack(g.x).astype(float), np.ones(len(g))])
                t = np.stack(g.y).astype(float)
                v = np.concatenate([(a.T @ a).ravel(), (a.T @ t).ravel(), (t * t).sum(0), [a.shape[1], t.shape[1]]])
                if k in held:
                    held[k][:-2] += v[:-2]
                else:
                    held[k] = v
        b = bucket()
        yield pd.DataFrame([(k, b, v[:-2], v[-2], v[-1]) for k, v in held.items()], columns=["key", "bucket", "v", "d", "t"])

    rows = df.select(F.col(key).cast("int").alias("key"), F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null and key is not null")
    shape = rows.select(F.size("x").alias("d"), F.size("y").alias("t")).first()
    if shape is None:
        return {}
    d, t = shape.d + 1, shape.t
    out = {}
    for k, v in added(rows.mapInPandas(part, "key int, bucket int, v array<double>, d double, t double").select("key", "bucket", "v")).items():
        out[k] = Sums(v[: d * d].reshape(d, d), v[d * d : d * d + d * t].reshape(d, t), v[d * d + d * t :])
    return out


def total(parts) -> Sums:
    first, *rest = parts
    for p in rest:
        first = first + p
    return first


def group_folds(sizes: dict[int, float], folds: int) -> dict[int, int]:
    """Group -> fold: the largest group first (ties: larger group), each into the lightest fold (ties: first)."""
    load, out = [0.0] * min(folds, len(sizes)), {}
    for g in sorted(sizes, key=lambda g: (sizes[g], g), reverse=True):
        out[g] = int(np.argmin(load))
        load[out[g]] += sizes[g]
    return out


@dataclass
class Probe:
    """coefficients and alpha (by target) of each outer fold; test groups of each fold; metrics over all rows."""

    status: str
    n: int
    coefficients: dict[int, np.ndarray]
    alpha: dict[int, np.ndarray]
    groups: dict[int, list[int]]
    mse: dict[int, float]
    overall: dict[str, float]


def nested_ridge(parts: dict[int, Sums], folds: int = 5, inner: int = 3, alphas=(0.1, 10.0, 1000.0)) -> Probe:
    """Nested grouped cross-validation of one target, from the sums of the groups: no further pass over the rows.

    Alpha has the least mean of inner mean squared errors (ties: smaller). Under 3 groups, 30 rows or without variance of
    the target the status is insufficient_support.
    """
    whole = total(parts.values()) if parts else None
    n = int(whole.n) if parts else 0
    if len(parts) < 3 or n < 30 or whole.yy[0] / n - (whole.xy[-1, 0] / n) ** 2 < 1e-24:
        return Probe("insufficient_support", n, {}, {}, {}, {}, {})
    outer = group_folds({g: p.n for g, p in parts.items()}, folds)
    b, chosen, tests, mse, tested = {}, {}, {}, {}, []
    for f in sorted(set(outer.values())):
        train = {g: p for g, p in parts.items() if outer[g] != f}
        cut = group_folds({g: p.n for g, p in train.items()}, inner)
        errors = {}
        for alpha in alphas:
            errors[alpha] = 0.0
            for i in set(cut.values()):
                w = total(p for g, p in train.items() if cut[g] != i).ridge(alpha)
                held = total(p for g, p in train.items() if cut[g] == i)
                errors[alpha] += float(held.sse(w)[0]) / held.n
        best = min(sorted(alphas), key=errors.__getitem__)
        b[f], chosen[f] = total(train.values()).ridge(best), np.array([best])
        tests[f] = sorted(g for g in parts if outer[g] == f)
        test = total(parts[g] for g in tests[f])
        mse[f] = float(test.sse(b[f])[0]) / test.n
        tested.append((test, b[f]))
    return Probe("complete", n, b, chosen, tests, mse, pooled(tested))


def pooled(tested: list[tuple[Sums, np.ndarray]]) -> dict[str, float]:
    """mse, r2 and pearson of the first target over all test folds, each with its own coefficients."""
    n = sum(s.n for s, _ in tested)
    sse = sum(float(s.sse(b)[0]) for s, b in tested)
    sy, yy = sum(float(s.xy[-1, 0]) for s, _ in tested), sum(float(s.yy[0]) for s, _ in tested)
    sp, pp = sum(float((s.xx[-1] @ b)[0]) for s, b in tested), sum(float((b * (s.xx @ b)).sum(0)[0]) for s, b in tested)
    py = sum(float((b * s.xy).sum(0)[0]) for s, b in tested)
    vy, vp = yy - sy * sy / n, pp - sp * sp / n
    r = (py - sy * sp / n) / np.sqrt(vy * vp) if vp > 1e-12 * n and vy > 0 else 0.0
    return {"mse": sse / n, "r2": 1 - sse / vy if vy > 0 else float("nan"), "pearson": float(r)}


def blocked_ridge(parts: dict[int, Sums], alphas) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(coefficients, alpha of each target) of each fold, from the other folds' sums.

    Features are scaled on the outer training folds; an inner fold is left out at a time; ties go to the larger alpha.
    """
    coefficients, chosen = {}, {}
    for f in parts:
        train = {g: p for g, p in parts.items() if g != f}
        if len(train) < 2:
            raise ValueError("blocked ridge needs three folds")
        sd = total(train.values()).sd()
        best = errors = None
        for alpha in sorted(alphas, reverse=True):
            e = sum(p.sse(total(q for h, q in train.items() if h != g).ridge(alpha, sd)) for g, p in train.items())
            if best is None:
                best, errors = np.full(len(e), alpha), e
            else:
                best, errors = np.where(e < errors, alpha, best), np.minimum(e, errors)
        every = total(train.values())
        fits = {a: every.ridge(a, sd) for a in set(best.tolist())}
        coefficients[f] = np.column_stack([fits[a][:, t] for t, a in enumerate(best.tolist())])
        chosen[f] = best
    return coefficients, chosen


def predicted(df: DataFrame, x: str, key: str, coefficients: dict[int, np.ndarray], name: str = "prediction") -> DataFrame:
    """df with the array of predictions by the coefficients of each row's key; null where x or the key has none."""
    table = {int(k): np.asarray(b) for k, b in coefficients.items()}

    def run(pieces: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, keys in pieces:
            out = np.empty(len(vectors), dtype=object)
            out[:] = None
            for k, b in table.items():
                at = np.flatnonzero(((keys == k) & vectors.notna()).to_numpy())
                if len(at):
                    p = np.column_stack([np.stack(vectors.iloc[at].to_list()).astype(float), np.ones(len(at))]) @ b
                    for i, row in zip(at, p, strict=True):
                        out[i] = row
            yield pd.Series(out)

    return df.withColumn(name, F.pandas_udf(run, "array<double>")(F.col(x), F.col(key).cast("int")))


# ---- ridge with leave-one-out choice ---------------------------------------------------------------------------


def leave_one_out_ridge(df: DataFrame, x: str, y: str, fold: str, alphas) -> dict[int, tuple[float, np.ndarray, dict[str, float]]]:
    """fold -> (alpha, coefficients, test metrics): each outer training set picks the alpha of least leave-one-out error.

    The leverages come from one more pass, in which a task adds up the squared errors of every fold and alpha.
    """
    parts = sums(df.withColumn("_y", F.array(F.col(y).cast("double"))).where(F.col(y).isNotNull()), x, "_y", fold)
    models = {}
    for f in parts:
        train = [p for g, p in parts.items() if g != f]
        if not train:
            continue
        s = total(train)
        mean, sd = s.xx[-1, :-1] / s.n, s.sd()
        cov = (s.xx[:-1, :-1] - s.n * np.outer(mean, mean)) / np.outer(sd, sd)
        values, q = np.linalg.eigh(cov)
        values = np.maximum(values, 0)
        along = q.T @ ((s.xy[:-1, 0] - mean * s.xy[-1, 0]) / sd)
        models[f] = (mean, sd, q, values, along, s.xy[-1, 0] / s.n, s.n)
    alphas = list(alphas)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {f: np.zeros(len(alphas)) for f in models}
        for pdf in batches:
            a, t, at = np.stack(pdf.x).astype(float), pdf.y.to_numpy(float), pdf.f.to_numpy()
            for f, (mean, sd, q, values, along, ym, n) in models.items():
                rows = at != f
                z = ((a[rows] - mean) / sd) @ q
                for i, alpha in enumerate(alphas):
                    inverse = 1 / (values + alpha)
                    error = t[rows] - ym - z @ (inverse * along)
                    leverage = 1 / n + (z * z) @ inverse
                    held[f][i] += float(((error / np.maximum(1 - leverage, 1e-12)) ** 2).sum())
        b = bucket()
        yield pd.DataFrame({"key": list(held), "bucket": [b] * len(held), "v": list(held.values())})

    rows = df.select(F.col(fold).cast("int").alias("f"), F.col(x).alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and f is not null")
    errors = added(rows.mapInPandas(part, "key int, bucket int, v array<double>")) if models else {}
    out = {}
    for f, e in errors.items():
        alpha = alphas[int(np.argmin(e))]
        b = total(p for g, p in parts.items() if g != f).ridge(alpha)
        out[f] = (alpha, b, pooled([(parts[f], b)]))
    return out


# ---- logistic --------------------------------------------------------------------------------------------------


def logistic_fits(df: DataFrame, x: str, y: str, fold: str, models: list[tuple[frozenset, float, np.ndarray]], rounds: int = 40) -> list[np.ndarray]:
    """Coefficients (intercept last, not penalised) of C * log-loss + |w * sd|^2 / 2 for all models (left-out folds, C, sd).

    Newton steps for all models at once: each round is one pass whose tasks send a gradient and a Hessian a model. A step
    that raises the loss is halved. Raises if a model has not converged after `rounds`.
    """
    d = len(models[0][2]) + 1
    rows = df.select(F.col(fold).cast("int").alias("f"), F.col(x).alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and f is not null").persist()
    w = [np.zeros(d) for _ in models]
    last: list[float | None] = [None] * len(models)
    step = [np.zeros(d) for _ in models]
    open_ = set(range(len(models)))
    for _ in range(rounds):
        now = {m: (models[m][0], w[m]) for m in sorted(open_)}

        def part(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            held = {m: np.zeros(d * d + d + 1) for m in now}
            for pdf in batches:
                a, t, at = np.column_stack([np.stack(pdf.x).astype(float), np.ones(len(pdf))]), pdf.y.to_numpy(float), pdf.f.to_numpy()
                for m, (out, b) in now.items():
                    keep = ~np.isin(at, list(out))
                    s, u = a[keep], t[keep]
                    z = s @ b
                    p = 0.5 * (1 + np.tanh(z / 2))
                    held[m] += np.concatenate([((s * (p * (1 - p))[:, None]).T @ s).ravel(), s.T @ (p - u), [float((np.logaddexp(0, z) - u * z).sum())]])
            k = bucket()
            yield pd.DataFrame({"key": list(held), "bucket": [k] * len(held), "v": list(held.values())})

        for m, v in added(rows.mapInPandas(part, "key int, bucket int, v array<double>")).items():
            _out, c, sd = models[m]
            penalty = np.array([*(sd * sd), 0.0])
            loss = c * v[-1] + float((penalty * w[m] ** 2).sum()) / 2
            if last[m] is not None and loss > last[m] + 1e-9 * abs(last[m]):
                step[m] = step[m] / 2
                w[m] = w[m] - step[m]
                continue
            last[m] = loss
            g = c * v[d * d : -1] + penalty * w[m]
            step[m] = -np.linalg.solve(c * v[: d * d].reshape(d, d) + np.diag(penalty) + 1e-10 * np.eye(d), g)
            w[m] = w[m] + step[m]
            if float(-(g @ step[m])) <= 1e-10 * max(1.0, abs(loss)):
                open_.discard(m)
        if not open_:
            break
    rows.unpersist()
    if not open_:
        return w
    raise RuntimeError(f"{len(open_)} logistic models did not converge in {rounds} rounds")


def blocked_logistic(df: DataFrame, x: str, y: str, fold: str, cs=(0.01, 0.1, 1.0)) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """(coefficients, C) of each fold: C has the best mean of inner AUROCs, a training fold left out at a time (ties: smaller)."""
    from marlstone.operators import ordered

    parts = sums(df.withColumn("_y", F.array(F.col(y).cast("double"))).where(F.col(y).isNotNull()), x, "_y", fold)
    folds = sorted(parts)
    if len(folds) < 3:
        raise ValueError("blocked logistic needs three folds")
    sd = {f: total(p for g, p in parts.items() if g != f).sd() for f in folds}
    cs = sorted(cs)
    inner = [(f, g, c) for f in folds for g in folds if g != f for c in cs]
    fits = logistic_fits(df, x, y, fold, [(frozenset((f, g)), c, sd[f]) for f, g, c in inner])
    # the scores of a held-out inner fold by every model that left it out
    by_fold = {g: np.column_stack([b for (_f, h, _c), b in zip(inner, fits, strict=True) if h == g]) for g in folds}
    names = {g: [(f, c) for f, h, c in inner if h == g] for g in folds}
    scored = predicted(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y, fold), x, fold, by_fold, "_s").select(F.col(fold).cast("int").alias("g"), F.col(y).alias("y"), F.posexplode("_s").alias("m", "s"))
    score: dict[tuple[int, float], list[float]] = {}
    for r in ordered.auroc(scored, "s", F.col("y") == 1, by=("g", "m")).collect():  # a row for each fold and model
        if r.auroc is not None:
            score.setdefault(names[r.g][r.m], []).append(r.auroc)
    chosen = {f: min(cs, key=lambda c: (-round(float(np.mean(score.get((f, c), [0.0]))), 12), c)) for f in folds}
    final = logistic_fits(df, x, y, fold, [(frozenset((f,)), chosen[f], sd[f]) for f in folds])
    return dict(zip(folds, final, strict=True)), chosen


# ---- compression and imputation --------------------------------------------------------------------------------


def replicate_weights(groups: list) -> np.ndarray:
    """1 / sqrt(size of its group) for each feature, so that a set of replicates weighs as one."""
    return np.array([1 / np.sqrt(groups.count(g)) for g in groups])


def compressor(s: Sums, k: int, blocks: list[list[int]] | None = None, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(loadings d x m, share of energy of each): truncated SVD of the weighted features, over all or block by block.

    From X'X, not centred; a block gives min(k, its width) axes; the largest loading of an axis is positive.
    """
    d = len(s.xx) - 1
    w = np.ones(d) if weights is None else weights
    xx = s.xx[:-1, :-1] * np.outer(w, w)
    columns, shares = [], []
    for block in blocks or [list(range(d))]:
        values, vectors = np.linalg.eigh(xx[np.ix_(block, block)])
        for i in np.argsort(-values, kind="stable")[: min(k, len(block))]:
            u = vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i])
            column = np.zeros(d)
            column[block] = u * w[block]
            columns.append(column)
            shares.append(max(values[i], 0) / max(np.trace(xx), 1e-300))
    return np.column_stack(columns), np.array(shares)


@dataclass
class Imputer:
    k: int
    alpha: float
    error: float
    coefficients: np.ndarray  # from observed logits and one to target logits
    prior: np.ndarray
    grid: list[tuple[int, float, float]]


def logits(column, eps: float):
    """Logit of each value clipped to [eps, 1 - eps]; null and NaN stay null."""

    def one(v):
        c = F.least(F.greatest(v.cast("double"), F.lit(eps)), F.lit(1 - eps))
        return F.when(v.isNotNull() & ~F.isnan(v), F.log(c) - F.log1p(-c))

    return F.transform(column, one)


def filled(column, prior: np.ndarray):
    """Values less the prior, 0 where there is none."""
    return F.zip_with(column, F.array(*(F.lit(float(p)) for p in prior)), lambda v, p: F.coalesce(v - p, F.lit(0.0)))


def means(df: DataFrame, column: str, width: int) -> np.ndarray:
    """Mean of each position over the rows that have a value there; 0 where none has."""
    rows = df.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()  # a row a position
    out = np.zeros(width)
    for r in rows:
        out[r.i] = r.m if r.m is not None else 0.0
    return out


def fit_imputer(train: DataFrame, validation: DataFrame, observed: str, target: str, ks, alphas, eps: float = 1e-3) -> Imputer:
    """Top-k axes of the observed residuals (logit less the training mean), ridge from them onto the target residuals.

    k and alpha have the least squared error of validation rows' target values (not logits); the first of equals wins.
    """
    both = train.select(logits(F.col(observed), eps).alias("o"), logits(F.col(target), eps).alias("t"))
    widths = both.select(F.size("o").alias("d"), F.size("t").alias("m")).first()
    po, pt = means(both, "o", widths.d), means(both, "t", widths.m)
    s = sums(both.select(filled(F.col("o"), po).alias("o"), filled(F.col("t"), pt).alias("t"), F.lit(0).alias("key")), "o", "t", "key")[0]
    mu = s.xx[-1, :-1] / s.n
    values, vectors = np.linalg.eigh(s.xx[:-1, :-1] - s.n * np.outer(mu, mu))
    order = np.argsort(-values, kind="stable")[: max(ks)]
    values, vectors = np.maximum(values[order], 1e-8), vectors[:, order]
    zy = vectors.T @ (s.xy[:-1] - np.outer(mu, s.xy[-1]))
    cells, fits = [], []
    for k in ks:
        for alpha in alphas:
            b = vectors[:, :k] @ (zy[:k] / (values[:k] + alpha)[:, None])
            cells.append((k, alpha))
            fits.append(np.vstack([b, pt - (po + mu) @ b]))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(len(fits) + 1)
        for pdf in batches:
            a = np.column_stack([np.stack(pdf.o).astype(float) + po, np.ones(len(pdf))])
            t = np.array([[np.nan if v is None else v for v in row] for row in pdf.t], dtype=float)
            has = np.isfinite(t)
            for i, b in enumerate(fits):
                held[i] += float((np.where(has, 1 / (1 + np.exp(-(a @ b))) - t, 0) ** 2).sum())
            held[-1] += has.sum()
        yield pd.DataFrame({"key": [0], "bucket": [bucket()], "v": [held]})

    v = validation.select(filled(logits(F.col(observed), eps), po).alias("o"), F.col(target).cast("array<double>").alias("t")).where("o is not null and t is not null")
    errors = added(v.mapInPandas(part, "key int, bucket int, v array<double>"))[0]
    if errors[-1] == 0:
        raise ValueError("no validation value")
    mse = errors[:-1] / errors[-1]
    best = int(np.argmin(mse))
    return Imputer(*cells[best], float(mse[best]), fits[best], po, [(k, a, float(e)) for (k, a), e in zip(cells, mse, strict=True)])


def impute(df: DataFrame, observed: str, model: Imputer, eps: float = 1e-3, name: str = "imputed") -> DataFrame:
    """df with the target values that the observed ones tell; a missing observed value counts as its prior logit."""
    full = F.zip_with(logits(F.col(observed), eps), F.array(*(F.lit(float(p)) for p in model.prior)), lambda v, p: F.coalesce(v, p))
    p = predicted(df.withColumn("_o", full).withColumn("_k", F.lit(0)), "_o", "_k", {0: model.coefficients}, "_p")
    return p.withColumn(name, F.transform("_p", lambda v: 1 / (1 + F.exp(-v)))).drop("_o", "_k", "_p")


# ---- eigenvectors of contact maps ------------------------------------------------------------------------------


def compartments(contacts: DataFrame, bins: DataFrame, k: int = 3, skip: int = 2, clip: float = 99.9) -> DataFrame:
    """(chrom, bin, eigenvector, value): leading axes of each chromosome's observed over expected contacts, less one.

    contacts has (chrom, i, j, value) with i <= j and one row a pair; bins has (chrom, bin, gc, valid), all bins. The
    expected value of a distance is its sum over its pairs of valid bins; distances under `skip` are left out. Axes are
    ordered by the size of their eigenvalue, scaled to its square root, and positive along gc. A chromosome's matrix (its
    length over the bin width, some thousand bins) is one task's; invalid bins have null.
    """
    joined = contacts.select("chrom", "i", "j", "value").where(F.col("j") - F.col("i") >= skip)
    rows = joined.groupBy("chrom").cogroup(bins.select(F.col("chrom").alias("_chrom"), "bin", "gc", "valid").groupBy("_chrom"))

    def run(pixels: pd.DataFrame, axis: pd.DataFrame) -> pd.DataFrame:
        if axis.empty:
            return pd.DataFrame(columns=["chrom", "bin", "eigenvector", "value"])
        axis = axis.sort_values("bin").reset_index(drop=True)
        n, place = len(axis), {b: p for p, b in enumerate(axis.bin)}
        m = np.zeros((n, n))
        for i, j, v in zip(pixels.i.map(place), pixels.j.map(place), pixels.value, strict=True):
            if i == i and j == j:
                m[int(i), int(j)] = m[int(j), int(i)] = v
        ok = axis.valid.to_numpy(bool)
        pair = np.outer(ok, ok)
        at = axis.bin.to_numpy()
        far = np.abs(at[:, None] - at[None, :])
        use = pair & (far >= skip)
        oe = np.zeros((n, n))
        for d in np.unique(far[use]):
            here = use & (far == d)
            mean = m[here].mean()
            oe[here] = m[here] / mean if mean > 0 else 0.0
        if use.any():
            oe = np.minimum(oe, np.percentile(oe[use], clip))
        oe = np.where(use, oe - 1, 0.0)[np.ix_(ok, ok)]
        values, vectors = np.linalg.eigh(oe) if ok.any() else (np.zeros(0), np.zeros((0, 0)))
        gc = axis.gc.to_numpy(float)[ok]
        out = []
        for e, p in enumerate(np.argsort(-np.abs(values), kind="stable")[:k]):
            u = vectors[:, p] * np.sqrt(abs(values[p]))
            has = np.isfinite(gc)
            c = np.corrcoef(u[has], gc[has])[0, 1] if has.sum() > 1 and u[has].std() > 0 and gc[has].std() > 0 else 1.0
            full = np.full(n, np.nan)
            full[ok] = u if c >= 0 else -u
            out += [(axis._chrom.iloc[0], b, e + 1, None if v != v else v) for b, v in zip(axis.bin, full, strict=True)]
        return pd.DataFrame(out, columns=["chrom", "bin", "eigenvector", "value"])

    return rows.applyInPandas(run, f"chrom {bins.schema['chrom'].dataType.simpleString()}, bin long, eigenvector int, value double")
