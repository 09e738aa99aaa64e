"""Exact linear estimators from sufficient statistics: tasks add up Gram matrices, the driver solves d x d systems."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, x: str, y: str, fold: str) -> dict[int, tuple[np.ndarray, np.ndarray, float, float]]:
    """fold -> (X'X, X'y, y'y, n) with a column of ones; tasks send a d x d matrix for each fold they have seen."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for pdf in batches:
            for f, g in pdf.groupby("f"):
                a = np.column_stack([np.stack(g.x).astype(float), np.ones(len(g))])
                t = g.y.to_numpy(float)
                s = held.setdefault(int(f), [0.0, 0.0, 0.0, 0.0])
                s[0], s[1], s[2], s[3] = s[0] + a.T @ a, s[1] + a.T @ t, s[2] + float(t @ t), s[3] + len(t)
        yield pd.DataFrame([(f, s[0].ravel().tolist(), s[1].tolist(), s[2], s[3]) for f, s in held.items()], columns=["f", "xx", "xy", "yy", "n"])

    sums = (
        df.select(F.col(fold).cast("int").alias("f"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
        .where("x is not null and y is not null")
        .mapInPandas(part, "f int, xx array<double>, xy array<double>, yy double, n double")
    )
    # element sums by position: partial aggregates, then one row for each fold and position
    add = lambda c: sums.select("f", F.posexplode(c).alias("i", "v")).groupBy("f", "i").agg(F.sum("v").alias("v")).groupBy("f").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias(c))
    rows = add("xx").join(add("xy"), "f").join(sums.groupBy("f").agg(F.sum("yy").alias("yy"), F.sum("n").alias("n")), "f").collect()
    out = {}
    for r in rows:
        d = len(r.xy)
        out[r.f] = (np.array(r.xx).reshape(d, d), np.array(r.xy), r.yy, r.n)
    return out


def solve_ridge(xx: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients with the intercept last and not penalised."""
    penalty = np.eye(len(xy)) * alpha
    penalty[-1, -1] = 0
    return np.linalg.solve(xx + penalty, xy)


def blocked_ridge(df: DataFrame, x: str, y: str, fold: str, alphas: list[float]) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """For each outer fold: coefficients from the others, with the alpha of least inner squared error (ties: larger)."""
    parts = gram(df, x, y, fold)
    coefficients, chosen = {}, {}
    for out in parts:
        inner = [f for f in parts if f != out]
        if not inner:
            continue
        best = None
        for alpha in sorted(alphas, reverse=True):
            error = 0.0
            for f in inner if len(inner) > 1 else []:
                train = [parts[g] for g in inner if g != f]
                b = solve_ridge(sum(p[0] for p in train), sum(p[1] for p in train), alpha)
                xx, xy, yy, _ = parts[f]
                error += yy - 2 * b @ xy + b @ xx @ b
            if best is None or error < best[0] - 1e-12:
                best = (error, alpha)
        chosen[out] = best[1]
        coefficients[out] = solve_ridge(sum(parts[f][0] for f in inner), sum(parts[f][1] for f in inner), best[1])
    return coefficients, chosen


def out_of_fold(df: DataFrame, x: str, fold: str, coefficients: dict[int, np.ndarray], name: str = "prediction") -> DataFrame:
    """df with each row's prediction from the folds that it isn't in."""
    table = F.create_map(*(v for f, b in coefficients.items() for v in (F.lit(f), F.array(*(F.lit(float(c)) for c in b)))))
    b = F.try_element_at(table, F.col(fold).cast("int"))
    product = F.aggregate(F.zip_with(F.col(x), b, lambda p, c: F.coalesce(p.cast("double"), F.lit(1.0)) * c), F.lit(0.0), lambda acc, v: acc + v)
    return df.withColumn(name, F.when(b.isNotNull(), product))  # the coefficient beyond x is the intercept


def principal_axes(df: DataFrame, x: str, k: int, standardise: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes k x d, explained variance); the largest loading of an axis is positive."""
    xx, _, _, n = gram(df.select(x, F.lit(0.0).alias("_y"), F.lit(0).alias("_f")), x, "_y", "_f")[0]
    mean = xx[-1, :-1] / n
    cov = xx[:-1, :-1] / n - np.outer(mean, mean)
    if standardise:
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd[sd < 1e-8] = 1
        cov = cov / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    axes = vectors[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return mean, axes, values[order]


def project(df: DataFrame, x: str, mean: np.ndarray, axes: np.ndarray, name: str = "scores") -> DataFrame:
    centred = F.zip_with(F.col(x), F.array(*(F.lit(float(m)) for m in mean)), lambda a, m: a.cast("double") - m)
    along = lambda u: F.aggregate(F.zip_with(centred, F.array(*(F.lit(float(v)) for v in u)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn(name, F.array(*(along(u) for u in axes)))
