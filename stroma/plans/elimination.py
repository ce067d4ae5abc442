"""SQL text that solves small systems of normal equations by elimination, for checking fits."""

from __future__ import annotations


def products(rows: str, keys: str, columns: list[str], out: str) -> str:
    """CTE ``out`` (keys, i, j, v): sums of products of all pairs of the expressions ``columns`` over the relation ``rows``."""
    listed = ", ".join(f"({c})::DOUBLE" for c in columns)
    k = len(columns)
    return f"""{out} AS (SELECT {keys}, i, j, sum(x[i + 1] * x[j + 1]) AS v FROM (SELECT {keys}, [{listed}] AS x FROM {rows}), (SELECT unnest(range({k})) AS i), (SELECT unnest(range({k})) AS j) GROUP BY ALL)"""


def eliminated(base: str, keys: list[str], pivots: list[int], out: str) -> list[str]:
    """CTEs ``out``1, ``out``2, ... that sweep one variable after the other out of ``base`` (keys, i, j, v); a key without the variable stays as it is.

    ``out``p is what ``out``p-1 is without the pivot's rows and columns; ``out``_pivots has
    (keys, k, v), the pivots' values.
    """
    on = lambda a, b: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)
    names, ctes, found = ", ".join(f"a.{k}" for k in keys), [], []
    before = base
    for step, p in enumerate(pivots, 1):
        found.append(f"SELECT {', '.join(keys)}, {p} AS k, v FROM {before} WHERE i = {p} AND j = {p}")
        ctes.append(
            f"{out}{step} AS (SELECT {names}, a.i, a.j, a.v - coalesce(b.v * c.v / d.v, 0) AS v FROM {before} a LEFT JOIN {before} b ON {on('a', 'b')} AND b.i = a.i AND b.j = {p} "
            f"LEFT JOIN {before} c ON {on('a', 'c')} AND c.i = {p} AND c.j = a.j LEFT JOIN {before} d ON {on('a', 'd')} AND d.i = {p} AND d.j = {p} WHERE a.i <> {p} AND a.j <> {p})"
        )
        before = f"{out}{step}"
    ctes.append(f"{out}_pivots AS ({' UNION ALL '.join(found)})")
    return ctes


def coefficients(base: str, keys: list[str], regressors: list[int], y: int, out: str) -> list[str]:
    """CTEs that solve ``base`` (keys, i, j, v) for the coefficients of ``regressors`` on ``y``; the last one, ``out``, is (keys, i, b)."""
    on = lambda a, b: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)
    names, ctes, before = ", ".join(f"a.{k}" for k in keys), [], base
    for step, p in enumerate(regressors, 1):
        ctes.append(
            f"{out}{step} AS (SELECT {names}, a.i, a.j, CASE WHEN a.i = {p} THEN a.v / d.v ELSE a.v - b.v * c.v / d.v END AS v FROM {before} a JOIN {before} d ON {on('a', 'd')} AND d.i = {p} AND d.j = {p} "
            f"JOIN {before} b ON {on('a', 'b')} AND b.i = a.i AND b.j = {p} JOIN {before} c ON {on('a', 'c')} AND c.i = {p} AND c.j = a.j)"
        )
        before = f"{out}{step}"
    ctes.append(f"{out} AS (SELECT {', '.join(keys)}, i, v AS b FROM {before} WHERE j = {y} AND i <> {y})")
    return ctes
