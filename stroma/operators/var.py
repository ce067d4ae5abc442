"""Vector autoregression over episodes: Gram matrices from executors, impulse responses on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.functions.calendar import MICROS, from_micros, micros
from stroma.functions.numbers import harmonics
from stroma.operators.linear import detrend, fit, gram, gram_matrix
from stroma.sources.tables import ship_package


def episodes(wide: DataFrame, series: list[str], ts: str, minutes: int, least: int) -> DataFrame:
    """Rows where all series are known, in blocks of neighbouring steps within a day, of ``least`` steps or more; adds episode and step."""
    full = wide.na.drop(subset=series).withColumn("_day", F.col(ts).cast("date"))
    w = W.partitionBy("_day").orderBy(ts)
    slot = F.floor(micros(ts) / (minutes * 60 * MICROS))
    block = full.withColumn("_g", slot - F.row_number().over(w))
    sized = block.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("_day", "_g"))).where(F.col("_n") >= least)
    named = sized.withColumn("episode", F.concat_ws("|", F.col("_day").cast("string"), F.col("_g").cast("string")))
    return named.withColumn("step", F.row_number().over(W.partitionBy("episode").orderBy(ts))).drop("_day", "_g", "_n")


def lagged(blocks: DataFrame, series: list[str], order: int) -> tuple[DataFrame, list[str]]:
    """The lag design, which never crosses an episode's border, and its regressors' names."""
    w = W.partitionBy("episode").orderBy("step")
    names = [f"{s}_lag{k}" for k in range(1, order + 1) for s in series]
    out = blocks.withColumns({f"{s}_lag{k}": F.lag(s, k).over(w) for k in range(1, order + 1) for s in series}).withColumn("one", F.lit(1.0))
    return out.na.drop(subset=names), ["one", *names]


def difference(blocks: DataFrame, series: list[str]) -> DataFrame:
    """First differences within episodes."""
    w = W.partitionBy("episode").orderBy("step")
    return blocks.select(*[c for c in blocks.columns if c not in series], *[(F.col(s) - F.lag(s).over(w)).alias(s) for s in series]).na.drop(subset=series)


@dataclass
class Model:
    series: list[str]
    order: int
    coefficients: np.ndarray  # (1 + K p) by K
    sigma: np.ndarray
    rows: int

    def lag(self, k: int) -> np.ndarray:
        n = len(self.series)
        return self.coefficients[1 + (k - 1) * n : 1 + k * n].T

    def companion(self) -> np.ndarray:
        n, p = len(self.series), self.order
        top = np.hstack([self.lag(k) for k in range(1, p + 1)])
        return np.vstack([top, np.eye(n * (p - 1), n * p)])

    def criteria(self) -> tuple[float, float]:
        k, p, t = len(self.series), self.order, self.rows
        log = np.linalg.slogdet(self.sigma)[1]
        return log + 2 / t * k * (k * p + 1), log + math.log(t) / t * k * (k * p + 1)

    def roots(self, minutes: int) -> list[dict]:
        """Eigenvalues of the companion matrix with their period and half-life in minutes."""
        out = []
        for z in np.linalg.eigvals(self.companion()):
            r, a = abs(z), abs(math.atan2(z.imag, z.real))
            out.append({"real": float(z.real), "imag": float(z.imag), "modulus": float(r), "period": 2 * math.pi / a * minutes if a > 1e-12 else None, "half_life": math.log(0.5) / math.log(r) * minutes if 0 < r < 1 else None})
        return sorted(out, key=lambda x: -x["modulus"])

    def responses(self, horizon: int, first: list[int] | None = None) -> np.ndarray:
        """Orthogonal responses [step, of, to]; ``first`` is the order of the Cholesky factor."""
        n = len(self.series)
        at = np.array(first or range(n))
        permuted = self.sigma[np.ix_(at, at)]
        try:
            root = np.linalg.cholesky(permuted)
        except np.linalg.LinAlgError:
            root = np.linalg.cholesky(permuted + 1e-8 * np.eye(n))
        back = np.argsort(at)
        impact = root[np.ix_(back, back)]
        phi, out = [np.eye(n)], []
        for s in range(horizon + 1):
            if s:
                phi.append(sum((self.lag(k) @ phi[s - k] for k in range(1, min(s, self.order) + 1)), np.zeros((n, n))))
            out.append(phi[s] @ impact)
        return np.array(out)


def fit_var(blocks: DataFrame, series: list[str], order: int) -> Model:
    design, x = lagged(blocks, series, order)
    return from_gram(gram_matrix(design, [*x, *series]), series, order)


def from_gram(matrix: np.ndarray, series: list[str], order: int) -> Model:
    n_x, t = 1 + len(series) * order, float(matrix[0, 0])
    b, rest = fit(matrix, n_x)
    return Model(series, order, b, (rest + rest.T) / (2 * t), int(t))


def matched_roots(before: Model, after: Model, minutes: int) -> list[dict]:
    """Each root of ``before`` in the upper half plane, largest first, with the root of ``after`` of the nearest frequency: (rank, modulus, period, modulus_after, period_after, moved).

    Frequencies are angles a step, from 0 to pi; of equally near roots the one of the nearest
    modulus counts. ``moved`` is the difference of the angles. NULL periods have no oscillation.
    """

    def upper(m: Model) -> list[tuple[float, float]]:
        found = [(abs(z), abs(math.atan2(z.imag, z.real))) for z in np.linalg.eigvals(m.companion()) if z.imag > -1e-9]
        return sorted(((float(r), float(a)) for r, a in found), key=lambda x: (-round(x[0], 9), x[1]))

    period = lambda a: 2 * math.pi / a * minutes if a > 1e-9 else None
    out, others = [], upper(after)
    for rank, (r, a) in enumerate(upper(before), 1):
        r2, a2 = min(others, key=lambda x: (round(abs(x[1] - a), 9), abs(x[0] - r)))
        out.append({"rank": rank, "modulus": r, "period": period(a), "modulus_after": r2, "period_after": period(a2), "moved": a2 - a})
    return out


def oscillation_placebo(cells: DataFrame, entity: str, series: list[str], ts: str, value: str, hours: str, base: list[tuple[float, int]], extra: list[float], minutes: int, least: int, order: int) -> list[dict]:
    """``matched_roots`` of the model of ``cells`` (entity, ts, value, hours) detrended with ``base`` harmonics (period in hours, number), and with one more harmonic at each of the ``extra`` periods.

    If an oscillation of the model came from a cycle at such a period, its root would
    vanish with it. Each detrending is one table of sums an entity; each model one more.
    """

    def model(terms: list[Column]) -> Model:
        named = {f"_x{i}": t for i, t in enumerate(terms)}
        rest = detrend(cells.where(F.col(value).isNotNull()).withColumns(named), entity, value, list(named), "_rest")[0]
        wide = rest.groupBy(ts).pivot(entity, series).agg(F.first("_rest"))
        return fit_var(episodes(wide, series, ts, minutes, least), series, order)

    usual = harmonics(F.col(hours), base)
    return matched_roots(model(usual), model([*usual, *harmonics(F.col(hours), [(p, 1) for p in extra])]), minutes)


def variance_shares(responses: np.ndarray, horizon: int, inclusive: bool = False) -> np.ndarray:
    """FEVD: row i's shares of shocks j, adding to 1: of the error ``horizon`` steps ahead (steps 0 to horizon - 1), or with ``inclusive`` the step at the horizon, too."""
    squares = (responses[: horizon + bool(inclusive)] ** 2).sum(0)
    return squares / squares.sum(1, keepdims=True)


def peak_and_half_life(curve: np.ndarray, minutes: int) -> tuple[float, float, float | None]:
    """(minutes to the largest absolute value, that value, minutes from there to below half of it)."""
    at = int(np.argmax(np.abs(curve)))
    top = abs(curve[at])
    below = np.flatnonzero(np.abs(curve[at:]) < top / 2)
    return float(at * minutes), float(curve[at]), float(below[0] * minutes) if top >= 1e-9 and len(below) else None


def bootstrap_responses(blocks: DataFrame, series: list[str], order: int, horizon: int, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """Percentile bands of the responses over resamples of whole episodes: (step, of, to, estimate, lo, hi).

    An episode's Gram matrix is computed once. A resample's matrix is their weighted sum, so
    no row is read again: matrices are stacked on executors, one group of episodes (by hash,
    a few hundred at most) a task, which weights them for every draw; the driver adds up
    one matrix a draw.
    """
    design, x = lagged(blocks, series, order)
    columns = [*x, *series]
    k, names = len(columns), list(series)
    each = gram(design, columns, ["episode"])
    episodes_ = each.select("episode").distinct().count()
    up = {(int(i), int(j)): n for n, (i, j) in enumerate(zip(*np.triu_indices(k)))}

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((draws, len(up)))
        place = np.array([up[i, j] for i, j in zip(rows["i"], rows["j"])])
        for name, own in rows.groupby("episode"):
            m = np.zeros(len(up))
            m[place[own.index]] = own["total"]
            digest = np.frombuffer(__import__("hashlib").sha256(f"{seed}:{name}".encode()).digest(), np.uint32)
            out += np.random.default_rng(digest).poisson(1.0, draws)[:, None] * m
        return pd.DataFrame({"draw": np.repeat(np.arange(draws), len(up)), "at": np.tile(np.arange(len(up)), draws), "total": out.ravel()})

    packed = each.withColumn("_g", F.pmod(F.xxhash64("episode"), F.lit(max(1, episodes_ // 200 + 1))))
    weighed = packed.groupBy("_g").applyInPandas(lambda rows: weigh(rows.reset_index(drop=True)), "draw int, at int, total double")
    sums = weighed.groupBy("draw", "at").agg(F.sum("total").alias("total"))
    entries = up

    def respond(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((k, k))
        flat = np.zeros(len(entries))
        flat[rows["at"]] = rows["total"]
        for (i, j), n in entries.items():
            m[i, j] = m[j, i] = flat[n]
        r = from_gram(m, names, order).responses(horizon)
        s, of, to = np.indices(r.shape)
        return pd.DataFrame({"step": s.ravel(), "of": [names[i] for i in of.ravel()], "to": [names[j] for j in to.ravel()], "value": r.ravel()})

    replicates = sums.groupBy("draw").applyInPandas(respond, "step int, of string, to string, value double")
    a = (1 - level) / 2
    band = replicates.groupBy("step", "of", "to").agg(F.percentile("value", a).alias("lo"), F.percentile("value", 1 - a).alias("hi"))
    r = fit_var(blocks, series, order).responses(horizon)
    point = [(s, series[i], series[j], float(r[s, i, j])) for s in range(horizon + 1) for i in range(len(series)) for j in range(len(series))]
    return blocks.sparkSession.createDataFrame(point, "step int, of string, to string, estimate double").join(band, ["step", "of", "to"])


def residuals(blocks: DataFrame, model: Model) -> DataFrame:
    """One column of residuals a series, by episode and step."""
    design, x = lagged(blocks, model.series, model.order)
    out = [
        (F.col(s) - sum((F.col(c) * float(model.coefficients[i, j]) for i, c in enumerate(x)), F.lit(0.0))).alias(s)
        for j, s in enumerate(model.series)
    ]
    return design.select("episode", "step", *out)


def pooled_acf(df: DataFrame, by: list[str], order: str, value: str, lags: int, over: list[str] | None = None) -> DataFrame:
    """(over, lag, n, acf): autocorrelation of each block ``by`` around its own mean, averaged within ``over`` (some of ``by``) with weights n - lag. One pass."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count(value).alias("_n"))
    w = W.partitionBy(*by).orderBy(order)
    centred = df.join(mean, by).withColumn("_c", F.col(value) - F.col("_m"))
    shifted = centred.withColumns({f"_l{k}": F.lag("_c", k).over(w) for k in range(lags + 1)})
    sums = shifted.groupBy(*by, "_n", "_v").agg(*[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(lags + 1)])
    pooled = over or []
    long = sums.where("_v > 0").select(*pooled, "_n", "_v", F.posexplode(F.array(*[F.col(f"_s{k}") for k in range(lags + 1)])).alias("lag", "_s")).where("_n > lag")
    weight = F.col("_n") - F.col("lag")
    return long.groupBy(*pooled, "lag").agg(F.sum(weight).alias("n"), (F.sum(weight * (F.col("_s") / weight / F.col("_v"))) / F.sum(weight)).alias("acf"))


def side_peak(acf: DataFrame, over: list[str], first: int) -> DataFrame:
    """(over, lag, acf): the largest autocorrelation at lag ``first`` or later, of equal ones the first."""
    key = F.struct(F.round("acf", 9).alias("a"), (-F.col("lag")).alias("l"))
    found = acf.where((F.col("lag") >= first) & F.col("acf").isNotNull()).groupBy(*over).agg(F.max_by("lag", key).alias("lag"), F.max_by("acf", key).alias("acf"))
    return found.select(*over, "lag", "acf")


def curve_acf(df: DataFrame, keys: list[str], order: str, value: str, lags: int) -> DataFrame:
    """(keys, lag, n, acf): unbiased autocorrelation of each key's curve: the mean product at the lag over the variance. All keys and lags in one pass."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    w = W.partitionBy(*keys).orderBy(order)
    centred = df.join(mean, keys).withColumn("_c", F.col(value) - F.col("_m"))
    shifted = centred.withColumns({f"_p{k}": F.col("_c") * (F.lag("_c", k).over(w) if k else F.col("_c")) for k in range(lags + 1)})
    shifted = shifted.select(*keys, "_v", F.posexplode(F.array(*[F.col(f"_p{k}") for k in range(lags + 1)])).alias("lag", "_p"))
    return shifted.where("_p is not null").groupBy(*keys, "lag").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.avg("_p"), F.any_value("_v")).alias("acf"))


def chi2_tail(x: float, df: float) -> float:
    """P(chi-squared > x): the incomplete gamma function by series or continued fraction."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - front * total)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def diagnostics(rest: DataFrame, series: list[str], lags: int) -> list[dict]:
    """Ljung-Box over ``lags`` and Jarque-Bera of each residual series, from distributed sums."""
    out = []
    for s in series:
        acf = {r["lag"]: r["acf"] for r in pooled_acf(rest, ["episode"], "step", s, lags).collect()}
        m = rest.agg(F.count(s).alias("n"), F.skewness(s).alias("skew"), F.kurtosis(s).alias("kurt")).first()
        n = m["n"]
        q = n * (n + 2) * sum(acf[k] ** 2 / (n - k) for k in range(1, lags + 1) if acf.get(k) is not None)
        jb = n / 6 * (m["skew"] ** 2 + m["kurt"] ** 2 / 4)
        out.append({"series": s, "n": n, "ljung_box": q, "ljung_box_p": chi2_tail(q, lags), "jarque_bera": jb, "jarque_bera_p": chi2_tail(jb, 2)})
    return out


def forecast_errors(blocks: DataFrame, model: Model, horizons: tuple[int, ...]) -> DataFrame:
    """(series, horizon, n, rmse, rmse_walk): recursive forecasts within episodes against the last value.

    An h-step forecast from a row is linear in the row's lags, so its matrix is computed
    once on the driver and applied as expressions.
    """
    design, x = lagged(blocks, model.series, model.order)
    k, names = len(model.series), model.series
    step = np.eye(1 + k * model.order)
    top = model.coefficients.T  # K by (1 + K p): constant, then lags
    shift = np.zeros_like(step)
    shift[0, 0] = 1
    shift[1 : 1 + k] = top
    for p in range(1, model.order):
        shift[1 + p * k : 1 + (p + 1) * k, 1 + (p - 1) * k : 1 + p * k] = np.eye(k)
    w = W.partitionBy("episode").orderBy("step")
    out = None
    for h in horizons:
        law = np.linalg.matrix_power(shift, h)[1 : 1 + k]  # from the state before a row to h - 1 rows after it
        cols = []
        for i, s in enumerate(names):
            truth = F.col(f"_truth_{i}")
            guess = sum((F.col(c) * float(law[i, j]) for j, c in enumerate(x)), F.lit(0.0))
            cols.append(F.struct(F.lit(s).alias("series"), (truth - guess).alias("e"), (truth - F.col(f"{s}_lag1")).alias("walk")))
        known = design.withColumns({f"_truth_{i}": F.lead(s, h - 1).over(w) for i, s in enumerate(names)})
        each = known.select(F.explode(F.array(*cols)).alias("c")).select("c.*").where("e is not null")
        one = each.groupBy("series").agg(F.lit(h).alias("horizon"), F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.sqrt(F.avg(F.col("walk") ** 2)).alias("rmse_walk"))
        out = one if out is None else out.unionByName(one)
    return out


def recursive_forecasts(blocks: DataFrame, ts: str, minutes: int, model: Model, horizons: list[int]) -> DataFrame:
    """(episode, step, ts, horizon, series, forecast, walk, truth): forecasts from each row that has the lags, ``horizons`` steps ahead within its episode.

    A row carries the model's state, its last ``order`` values, which is advanced step by
    step for all rows of an Arrow batch at once, each forecast being the next step's
    first value. ``ts`` is the time that is forecast; ``walk`` the last known value.
    """
    ship_package(blocks.sparkSession)
    names, p = model.series, model.order
    k = len(names)
    w = W.partitionBy("episode").orderBy("step")
    state = {f"_s{l}_{i}": F.lag(s, l).over(w) if l else F.col(s).cast("double") for l in range(p) for i, s in enumerate(names)}
    truth = {f"_t{h}_{i}": F.lead(s, h).over(w) for h in horizons for i, s in enumerate(names)}
    rows = blocks.select("episode", "step", micros(F.col(ts)).alias("_us"), *[c.cast("double").alias(n) for n, c in (state | truth).items()]).na.drop(subset=list(state))
    constant, law = model.coefficients[0], [model.lag(l) for l in range(1, p + 1)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda n: batch.column(batch.schema.names.index(n)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            held = [np.stack([col(f"_s{l}_{i}") for i in range(k)], 1) for l in range(p)]
            last = held[0]
            for h in range(1, max(horizons) + 1):
                ahead = constant + sum(x @ a.T for x, a in zip(held, law, strict=True))
                held = [ahead, *held[:-1]]
                if h in horizons:
                    for i, s in enumerate(names):
                        known = np.asarray(col(f"_t{h}_{i}"), float)
                        at = np.flatnonzero(~np.isnan(known))
                        take = lambda n: batch.column(batch.schema.names.index(n)).take(pa.array(at))  # noqa: B023, E731
                        yield pa.RecordBatch.from_pydict({"episode": take("episode"), "step": pa.array(col("step")[at].astype(np.int32)), "_us": pa.array(col("_us")[at] + h * minutes * 60 * MICROS), "horizon": pa.array(np.full(len(at), h, np.int32)), "series": pa.array([s] * len(at)), "forecast": pa.array(ahead[at, i]), "walk": pa.array(last[at, i]), "truth": pa.array(known[at])})

    made = rows.mapInArrow(run, "episode string, step int, _us long, horizon int, series string, forecast double, walk double, truth double")
    return made.select("episode", "step", from_micros(F.col("_us")).alias(ts), "horizon", "series", "forecast", "walk", "truth")


def forecast_scores(train: DataFrame, test: DataFrame, series: list[str], ts: str, minutes: int, order: int, horizons: list[int], by: list[Column] | None = None) -> DataFrame:
    """(by, series, horizon, n, rmse and mae of var, walk and mean): a model fitted on ``train``'s episodes against the last value and the mean of ``train`` at that weekday and hour, on ``test``'s episodes.

    Targets at a weekday and hour that ``train`` hasn't seen count for the first two alone.
    """
    forecasts = recursive_forecasts(test, ts, minutes, fit_var(train, series, order), horizons)
    known = train.select(F.weekday(ts).alias("_wd"), F.hour(ts).alias("_h"), F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("_v")) for s in series])).alias("c"))
    means = known.groupBy("_wd", "_h", "c.series").agg(F.avg("c._v").alias("mean"))  # at most 168 a series
    joined = forecasts.withColumns({"_wd": F.weekday(ts), "_h": F.hour(ts)}).join(F.broadcast(means), ["_wd", "_h", "series"], "left")
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col("truth") - F.col(c), 2)))
    mae = lambda c: F.avg(F.abs(F.col("truth") - F.col(c)))
    scores = [f(c).alias(f"{n}_{out}") for c, out in (("forecast", "var"), ("walk", "walk"), ("mean", "mean")) for n, f in (("rmse", rmse), ("mae", mae))]
    return joined.groupBy(*(by or []), "series", "horizon").agg(F.count(F.lit(1)).alias("n"), *scores)


def order_grid(blocks: DataFrame, series: list[str], most: int) -> list[tuple[Model, int]]:
    """Models of the orders 1 to ``most``, each on all rows that have its lags, from one pass; with each its number of parameters an equation.

    Rows are told apart by how many lags they have, at most ``most``; lags beyond count as
    0. The sums of an order are those of all rows with as many lags or more.
    """
    n = len(series)
    w = W.partitionBy("episode").orderBy("step")
    names = [f"{s}_lag{k}" for k in range(1, most + 1) for s in series]
    wide = blocks.withColumns({f"{s}_lag{k}": F.coalesce(F.lag(s, k).over(w), F.lit(0.0)) for k in range(1, most + 1) for s in series}).withColumn("one", F.lit(1.0))
    wide = wide.withColumn("_m", F.least(F.col("step") - 1, F.lit(most)).cast("int")).where("_m >= 1")
    size = 1 + n * most + n
    sums = np.zeros((most + 1, size, size))
    for r in gram(wide, ["one", *names, *series], ["_m"]).collect():  # orders times pairs of columns
        sums[r["_m"], r["i"], r["j"]] = sums[r["_m"], r["j"], r["i"]] = r["total"]
    out = []
    for p in range(1, most + 1):
        keep = [*range(1 + n * p), *range(1 + n * most, size)]
        m = sums[p:].sum(0)[np.ix_(keep, keep)]
        if m[0, 0] > 1 + n * p:
            out.append((from_gram(m, series, p), 1 + n * p))
    return out


def _by_known_lags(blocks: DataFrame, by: list[str], order: str, lagged_: dict[str, tuple[str, int]], most: int) -> DataFrame:
    """``blocks`` with lags (name: column and how far back), those beyond a block's start 0, and ``_m``, how many rows back there are, at most ``most``."""
    w = W.partitionBy(*by).orderBy(order)
    return blocks.withColumns({n: F.coalesce(F.lag(c, k).over(w), F.lit(0.0)) for n, (c, k) in lagged_.items()}).withColumn("_m", F.least(F.row_number().over(w) - 1, F.lit(most)).cast("int"))


def order_criteria(blocks: DataFrame, series: list[str], orders: list[int]) -> DataFrame:
    """(order, rows, parameters, log_det, aic, bic): the joint model of all ``series`` at each order, on all rows with its lags.

    One pass sums the products of the longest design by how many lags a row has; an
    order's matrix is the sum over rows with as many or more, cut to its columns, and is
    swept in a task of its own: the pivots of the series behind the regressors multiply to
    the residuals' determinant. NULL where rows don't exceed parameters or are dependent.
    """
    n, most = len(series), max(orders)
    lags = {f"{s}_lag{k}": (s, k) for k in range(1, most + 1) for s in series}
    wide = _by_known_lags(blocks, ["episode"], "step", lags, most).where("_m >= 1").withColumn("_one", F.lit(1.0))
    first_y = 1 + n * most
    asked = gram(wide, ["_one", *lags, *series], ["_m"]).withColumn("order", F.explode(F.array(*[F.lit(p) for p in orders])))
    within = lambda c: (F.col(c) < 1 + n * F.col("order")) | (F.col(c) >= first_y)
    sums = asked.where((F.col("order") <= F.col("_m")) & within("i") & within("j")).groupBy("order", "i", "j").agg(F.sum("total").alias("total"))

    def sweep(rows: pd.DataFrame) -> pd.DataFrame:
        p = int(rows["order"].iloc[0])
        at = {c: k for k, c in enumerate([*range(1 + n * p), *range(first_y, first_y + n)])}
        m = np.zeros((len(at), len(at)))
        i, j = rows["i"].map(at), rows["j"].map(at)
        m[i, j] = m[j, i] = rows["total"]
        t, size = m[0, 0], 1 + n * p
        log_det = None
        if t > size:
            scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
            try:
                root = np.diag(np.linalg.cholesky(m / np.outer(scale, scale))) * scale
                log_det = float(2 * np.log(root[size:]).sum() - n * math.log(t))
            except np.linalg.LinAlgError:
                pass
        known = log_det is not None
        return pd.DataFrame({"order": [p], "rows": [int(t)], "parameters": [size], "log_det": [log_det], "aic": [log_det + 2 / t * n * size if known else None], "bic": [log_det + math.log(t) / t * n * size if known else None]})

    return sums.groupBy("order").applyInPandas(sweep, "order int, rows long, parameters int, log_det double, aic double, bic double")


def guarded(blocks: DataFrame, series: list[str], orders: range, least: float = 3.0) -> DataFrame:
    """(order, rows, parameters, ratio, allowed): whether observations for each parameter are enough to fit all series together."""
    steps = blocks.groupBy("episode").agg(F.count(F.lit(1)).alias("_n"))
    asked = steps.select("_n", F.explode(F.array(*[F.lit(p) for p in orders])).alias("order"))
    rows = asked.groupBy("order").agg(F.sum(F.greatest(F.col("_n") - F.col("order"), F.lit(0))).alias("rows"))
    k = len(series)
    parameters = (k * F.col("order") + 1).cast("long")
    return rows.select("order", "rows", parameters.alias("parameters"), (F.col("rows") / parameters).alias("ratio"), (F.col("rows") / parameters > least).alias("allowed"))


def cross_correlation(df: DataFrame, by: list[str], order: str, pairs: list[tuple[str, str]], lags: range) -> DataFrame:
    """(a, b, lag, n, r): correlation of a with b ``lag`` rows before (after, where negative) within ``by``. All in one pass."""
    w = W.partitionBy(*by).orderBy(order)
    shifted = df.withColumns({f"_{b}_{k - lags.start}": F.lag(b, k).over(w) for b in {b for _, b in pairs} for k in lags})
    long = shifted.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("lag"), F.col(a).alias("x"), F.col(f"_{b}_{k - lags.start}").alias("y")) for a, b in pairs for k in lags])).alias("c")).select("c.*")
    return long.where("x is not null and y is not null").groupBy("a", "b", "lag").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))


#: MacKinnon's asymptotic critical values of the unit-root test with a constant (fixed values).
UNIT_ROOT = {0.01: -3.43, 0.05: -2.86, 0.10: -2.57}


def unit_root(df: DataFrame, by: list[str], order: str, value: str, lags: int, least: int) -> DataFrame:
    """(by, n, statistic, rejected_at_5): augmented Dickey-Fuller with a constant for each block of ``least`` rows or more; blocks are solved on the executors from their sums."""
    w = W.partitionBy(*by).orderBy(order)
    long = df.withColumn("_many", F.count(value).over(W.partitionBy(*by))).where(F.col("_many") >= least)
    d = long.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_y", F.lag(value).over(w)).withColumn("_one", F.lit(1.0))
    d = d.withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    columns = ["_y", "_one", *[f"_d{k}" for k in range(1, lags + 1)], "_d"]
    k = len(columns)
    kinds = dict(df.dtypes)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((k, k))
        m[rows["i"], rows["j"]] = m[rows["j"], rows["i"]] = rows["total"]
        b, rest = fit(m, k - 1)
        n = m[1, 1]
        free = n - (k - 1)
        se = math.sqrt(max(rest[0, 0], 0.0) / free * np.linalg.pinv(m[: k - 1, : k - 1])[0, 0]) if free > 0 else 0.0
        stat = float(b[0, 0] / se) if se > 0 else None
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in by}, "n": [int(n)], "statistic": [stat], "rejected_at_5": [None if stat is None else stat < UNIT_ROOT[0.05]]})

    return gram(d, columns, by).groupBy(*by).applyInPandas(solve, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n long, statistic double, rejected_at_5 boolean"]))


#: Response surfaces of MacKinnon's critical values of the test with a constant: b0 + b1 / n + b2 / n^2 + b3 / n^3 (fixed values, 2010).
SURFACES = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}


def critical_value(level: float, n: Column) -> Column:
    b0, b1, b2, b3 = SURFACES[level]
    return F.lit(b0) + b1 / n + b2 / (n * n) + b3 / (n * n * n)


def unit_root_lags(df: DataFrame, by: list[str], order: str, value: str, most: int, least: int) -> DataFrame:
    """(by, n, lags, statistic, p_range): augmented Dickey-Fuller with a constant, lags chosen by AIC, for each block of ``least`` values or more.

    Up to ``most`` lagged differences, and no more than 12 (n / 100)^(1/4) or a third of
    the block, are compared on the rows that have them all; the chosen regression then
    takes every row that has its lags. ``p_range`` is read from critical values at the
    rows taken: below 0.01, to 0.05, to 0.10, above. A block's sums of products are made
    from one pass, by how many lags a row has; no block is held whole. Null values are
    left out; constant blocks have no statistic.
    """
    known = df.where(F.col(value).isNotNull())
    w = W.partitionBy(*by).orderBy(order)
    d = known.withColumns({"_many": F.count(F.lit(1)).over(W.partitionBy(*by)), "_y": F.lag(value).over(w)}).withColumn("_d", F.col(value) - F.col("_y"))
    d = d.where((F.col("_many") >= least) & F.col("_y").isNotNull()).withColumn("_one", F.lit(1.0))
    lags = {f"_d{k}": ("_d", k) for k in range(1, most + 1)}
    wide = _by_known_lags(d, by, order, lags, most)
    columns, kinds = ["_one", "_y", *lags, "_d"], dict(df.dtypes)
    last = len(columns) - 1

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((most + 1, last + 1, last + 1))
        m, i, j = rows["_m"], rows["i"], rows["j"]
        sums[m, i, j] = sums[m, j, i] = rows["total"]
        n_all = sums[:, 0, 0].sum() + 1  # the first value has no difference
        top = int(max(0, min(most, math.ceil(12 * (n_all / 100) ** 0.25), n_all // 3)))

        def fitted(k: int, from_: int) -> tuple[np.ndarray, float, float, np.ndarray]:
            keep = [*range(2 + k), last]
            g = sums[from_:].sum(0)[np.ix_(keep, keep)]
            b, rest = fit(g, 2 + k)
            return b, float(rest[0, 0]), g[0, 0], g[: 2 + k, : 2 + k]

        def aic(k: int) -> float:
            _, rest, n, _ = fitted(k, top)
            return n * math.log(max(rest, 1e-300) / n) + 2 * (2 + k) if n > 2 + k else math.inf

        best = min(range(top + 1), key=lambda k: (round(aic(k), 9), k))
        b, rest, n, xx = fitted(best, best)
        free, spread = n - 2 - best, xx[1, 1] - xx[0, 1] ** 2 / xx[0, 0]
        stat = None
        if free > 0 and spread > 1e-12 * xx[1, 1] and rest > 1e-12 * sums[:, last, last].sum():
            se = math.sqrt(rest / free * np.linalg.pinv(xx)[1, 1])
            stat = float(b[1, 0] / se) if se > 0 else None
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in by}, "n": [int(n)], "lags": [best], "statistic": [stat]})

    found = gram(wide, columns, [*by, "_m"]).groupBy(*by).applyInPandas(solve, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n long, lags int, statistic double"]))
    s, n = F.col("statistic"), F.col("n")
    span = F.when(s < critical_value(0.01, n), "below 0.01").when(s < critical_value(0.05, n), "to 0.05").when(s < critical_value(0.10, n), "to 0.10").when(s.isNotNull(), "above 0.10")
    return found.withColumn("p_range", span)


def arch_lm(df: DataFrame, keys: list[str], block: list[str], order: str, value: str) -> DataFrame:
    """(keys, n, lm): Engle's test of one lag: n times the R squared of the squares on the squares before them in the same block; chi squared with one degree."""
    w = W.partitionBy(*keys, *block).orderBy(order)
    e = df.withColumn("_e", F.col(value) * F.col(value)).withColumn("_b", F.lag(F.col(value) * F.col(value)).over(w)).where("_e is not null and _b is not null")
    return e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * F.pow(F.corr("_e", "_b"), 2)).alias("lm"))


def odd_days(df: DataFrame, keys: list[str], day: str, value: str, factor: float = 3.0) -> DataFrame:
    """(keys, day, mean, deviation, odd): a day's mean against the median of all days, in median absolute deviations."""
    days = df.groupBy(*keys, day).agg(F.avg(value).alias("mean"))
    middle = days.groupBy(*keys).agg(F.median("mean").alias("_m"))
    off = days.join(middle, keys).withColumn("_o", F.abs(F.col("mean") - F.col("_m")))
    scale = off.groupBy(*keys).agg(F.median("_o").alias("_s"))
    deviation = F.try_divide(F.col("mean") - F.col("_m"), F.col("_s"))
    return off.join(scale, keys).select(*keys, day, "mean", deviation.alias("deviation"), F.coalesce(F.abs(deviation) > factor, F.lit(False)).alias("odd"))
