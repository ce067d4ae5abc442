"""Least squares from distributed sums: rows stay on the executors, small matrices reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stroma.sources.tables import ship_package


def gram(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, i, j, total): sums of the products of all pairs of ``columns`` (i <= j), over rows without nulls.

    Partial matrices are made by Arrow batch and group and summed after; one row a pair,
    batch and group is shuffled, however many rows there are.
    """
    ship_package(df.sparkSession)
    by = by or []
    # a new name for a column doubles the constraints that name it, so columns that are doubles keep theirs
    typed = dict(df.dtypes)
    clean = df.select(*by, *[F.col(c) if typed[c] == "double" else F.col(c).cast("double").alias(c) for c in columns])
    unsure = [c for c in columns if clean.schema[c].nullable]
    clean = clean.na.drop(subset=unsure) if unsure else clean
    kinds = dict(clean.dtypes)
    k = len(columns)
    up = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(len(by) + c).to_numpy(zero_copy_only=False) for c in range(k)], 1)
            table = pa.Table.from_batches([batch])
            if by:
                keys = table.select(by).to_pandas()
                groups = keys.groupby(by, sort=False, dropna=False).indices
            else:
                groups = {(): np.arange(len(x))}
            for key, rows in groups.items():
                part = x[rows].T @ x[rows]
                key = key if isinstance(key, tuple) else (key,)
                own = {b: pa.array([v] * len(up[0]), table.schema.field(b).type) for b, v in zip(by, key)}
                yield pa.RecordBatch.from_pydict({**own, "i": pa.array(up[0].astype(np.int32)), "j": pa.array(up[1].astype(np.int32)), "total": pa.array(part[up])})

    schema = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "i int, j int, total double"])
    return clean.mapInArrow(run, schema).groupBy(*by, "i", "j").agg(F.sum("total").alias("total"))


def gram_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The whole matrix on the driver: len(columns) squared numbers."""
    out = np.zeros((len(columns), len(columns)))
    for r in gram(df, columns).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["total"]
    return out


def fit(matrix: np.ndarray, n_x: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (n_x by n_y) of the last columns on the first ``n_x``, and the residuals' cross products."""
    xx, xy, yy = matrix[:n_x, :n_x], matrix[:n_x, n_x:], matrix[n_x:, n_x:]
    b = np.linalg.lstsq(xx, xy, rcond=None)[0]
    return b, yy - b.T @ xy - xy.T @ b + b.T @ xx @ b


def nested_fits(df: DataFrame, by: str, y: str, designs: dict[str, list[str]]) -> DataFrame:
    """(by, design, n, parameters, variance, aic, bic) of each group's regression of ``y`` on a constant and the columns of each design, from one pass.

    All columns' products are summed once; a design's matrix is cut out of that, on the
    executors, a group at a time. Variance is that of the residuals over n; AIC = n ln(var) + 2 k,
    BIC = n ln(var) + k ln(n). Rows of null ``y`` are left out; NULL where rows don't exceed parameters.
    """
    columns = list(dict.fromkeys(c for d in designs.values() for c in d))
    sums = gram(df.withColumn("_one", F.lit(1.0)), ["_one", *columns, y], [by])
    kind, size = dict(df.dtypes)[by], len(columns) + 2
    places = {name: [0, *(1 + columns.index(c) for c in d), size - 1] for name, d in designs.items()}

    def solve(rows):
        import pandas as pd

        m = np.zeros((size, size))
        m[rows["i"], rows["j"]] = m[rows["j"], rows["i"]] = rows["total"]
        n, out = m[0, 0], []
        for name, at in places.items():
            k = len(at) - 1
            var = None
            if n > k:
                _, rest = fit(m[np.ix_(at, at)], k)
                var = max(float(rest[0, 0]) / n, 1e-300)
            out.append((rows[by].iloc[0], name, int(n), k, var, None if var is None else n * np.log(var) + 2 * k, None if var is None else n * np.log(var) + k * np.log(n)))
        return pd.DataFrame(out, columns=[by, "design", "n", "parameters", "variance", "aic", "bic"])

    return sums.groupBy(by).applyInPandas(solve, f"`{by}` {kind}, design string, n long, parameters int, variance double, aic double, bic double")


def detrend(df: DataFrame, by: str, y: str, columns: list[str], out: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with the residual of each group's regression of ``y`` on ``columns`` (a constant is added), and a table of fits.

    Fits have n, the population variance of the residuals, AIC = n ln(var) + 2 k and
    BIC = n ln(var) + k ln(n). Rows of null ``y`` are left out of the fit and get NULL.
    """
    x = ["_one", *columns]
    with_one = df.withColumn("_one", F.lit(1.0))
    sums: dict = {}
    for r in gram(with_one, [*x, y], [by]).collect():  # one small matrix a group
        m = sums.setdefault(r[by], np.zeros((len(x) + 1, len(x) + 1)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["total"]
    fits, coefs = [], []
    for key, m in sums.items():
        b, rest = fit(m, len(x))
        n, var = m[0, 0], max(float(rest[0, 0]) / m[0, 0], 1e-300)
        fits.append((key, int(n), var, n * np.log(var) + 2 * len(x), n * np.log(var) + len(x) * np.log(n)))
        coefs.append((key, [float(v) for v in b[:, 0]]))
    spark, kind = df.sparkSession, dict(df.dtypes)[by]
    table = spark.createDataFrame([(k, n, float(v), float(a), float(c)) for k, n, v, a, c in fits], f"`{by}` {kind}, n long, variance double, aic double, bic double")
    lines = spark.createDataFrame(coefs, f"`{by}` {kind}, _b array<double>")
    line = sum((F.get("_b", F.lit(i)) * F.col(c) for i, c in enumerate(x) if i), F.get("_b", F.lit(0)))
    return with_one.join(lines, by, "left").withColumn(out, F.col(y) - line).drop("_one", "_b"), table
