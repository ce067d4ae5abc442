"""What is known at a vehicle's arrival, strictly before it: the features of its next stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stroma.sources.tables import materialise

from stroma.functions.calendar import MICROS, day_type, micros, rush_hour
from stroma.operators.ordered import lag_pairs
from stroma.operators.ranges import asof

MINUTE = 60 * MICROS
FEATURES = ["d_k", "d_km1", "rank", "way", "line", "hour", "rush", "day_kind", "plan_gap_pred", "act_gap_pred", "d_pred_k", "d_pred_k1", "net_mean15", "net_n15", "cancel_here30", "cancel_net30", "plan_run"]


def recent_sums(probes: DataFrame, stream: DataFrame, keys: list[str], ts: str, minutes: int, sums: dict[str, str]) -> DataFrame:
    """``probes`` with sums over the ``stream`` rows of the same keys in [t - minutes, t).

    Times are dealt into buckets as long as the window, so no task holds a whole key. What a probe sees
    of its own bucket comes before it, and what it sees of the bucket before reaches to that one's
    end: two running sums, one from each side, whose work grows with the rows and not with
    those of a window. A stream row stands in its bucket at its time, and in the next at the
    last time that sees it. Only sums of addends are taken, no differences.
    """
    width = minutes * MINUTE
    us = micros(F.col(ts))
    kept = F.struct(*probes.columns)
    kind = probes.select(kept).schema[0].dataType
    left = probes.select(*keys, us.alias("_us"), kept.alias("_row"), F.lit(None).cast("boolean").alias("_old"), *[F.lit(None).cast("double").alias(n) for n in sums]).withColumn("_b", F.floor(F.col("_us") / width))
    right = stream.where(F.col(ts).isNotNull()).select(*keys, us.alias("_us"), F.lit(None).cast(kind).alias("_row"), F.explode(F.array(F.lit(False), F.lit(True))).alias("_old"), *[F.col(c).cast("double").alias(n) for n, c in sums.items()])
    right = right.withColumn("_us", F.when(F.col("_old"), F.col("_us") + width).otherwise(F.col("_us"))).withColumn("_b", F.floor(F.col("_us") / width))
    row = F.col("_row").isNull()  # at one time, probes come before the rows of their bucket, and after those of the one before
    w = W.partitionBy(*keys, "_b")
    ahead = w.orderBy("_us", row).rowsBetween(W.unboundedPreceding, 0)
    back = w.orderBy(F.col("_us").desc(), ~row).rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right).withColumns({f"_new_{n}": F.sum(F.when(~F.col("_old"), F.col(n))).over(ahead) for n in sums})
    both = both.withColumns({f"_old_{n}": F.sum(F.when(F.col("_old"), F.col(n))).over(back) for n in sums})
    zero = F.lit(0.0)
    return both.where("_row is not null").select("_row.*", *[(F.coalesce(f"_new_{n}", zero) + F.coalesce(f"_old_{n}", zero)).alias(n) for n in sums])


def transition_features(stops: DataFrame) -> DataFrame:
    """One row for each step of a vehicle that ran to its stop k: (day, vehicle, pos, T), the features, and what came of it: cancelled_next, d_next, delta.

    ``stops``: day, vehicle, line, way, pos, place, sched, delay (minutes), cancelled. T is the
    real arrival at k. Whatever arrives at T or later isn't seen, two arrivals of one
    minute and instant don't see each other. The predecessor is the last vehicle that
    arrived at the next place before T.
    """
    real = F.timestamp_micros(micros("sched") + (F.col("delay") * MINUTE).cast("long")).cast("timestamp_ntz")
    rows = stops.withColumn("T", F.when(~F.col("cancelled"), real)).withColumn("_at", F.coalesce("T", "sched"))
    along = W.partitionBy("day", "vehicle").orderBy("pos")
    rows = rows.withColumn("d_km1", F.lag(F.when(~F.col("cancelled"), F.col("delay"))).over(along))
    steps = lag_pairs(rows, ["day", "vehicle"], ["pos"], ["pos", "place", "sched", "delay", "cancelled", "T", "d_km1"], suffix="_k").where("not cancelled_k")
    base = steps.select(
        "day", "vehicle", "line", "way", F.col("pos_k").alias("pos"), F.col("place_k").alias("here"), F.col("place").alias("place"), F.col("T_k").alias("T"), F.col("sched").alias("_sched_next"),
        F.col("delay_k").alias("d_k"), F.col("d_km1_k").alias("d_km1"), F.col("pos_k").alias("rank"), F.hour("sched_k").alias("hour"), rush_hour(F.col("sched_k")).alias("rush"), day_type(F.col("sched_k")).alias("day_kind"),
        ((micros("sched") - micros("sched_k")) / (1.0 * MINUTE)).alias("plan_run"), F.col("cancelled").alias("cancelled_next"), F.when(~F.col("cancelled"), F.col("delay")).alias("d_next"),
    )
    ran = rows.where("not cancelled").select("day", "place", "T", "vehicle", "sched", "delay", F.col("T").alias("arrived"))
    seen = asof(base, ran, ["day", "place"], "T", ["sched", "delay", "arrived"], "vehicle", prefix="_next_")
    here = ran.select("day", F.col("place").alias("here"), "T", "vehicle", "delay")
    seen = asof(seen, here, ["day", "here"], "T", ["delay"], "vehicle", prefix="_here_")
    seen = seen.withColumns(
        {
            "plan_gap_pred": (micros("_sched_next") - micros("_next_sched")) / (1.0 * MINUTE),
            "act_gap_pred": (micros("T") - micros("_next_arrived")) / (1.0 * MINUTE),
            "d_pred_k": F.col("_here_delay"),
            "d_pred_k1": F.col("_next_delay"),
            "delta": F.col("d_next") - F.col("d_k"),
        }
    )
    seen = recent_sums(seen, ran.withColumn("_one", F.lit(1.0)), ["day"], "T", 15, {"net_n15": "_one", "_net15": "delay"})
    gone = rows.where("cancelled").select("day", F.col("place").alias("here"), "way", F.col("_at").alias("T"), F.lit(1.0).alias("_one"))
    seen = recent_sums(seen, gone, ["day", "here", "way"], "T", 30, {"cancel_here30": "_one"})
    seen = recent_sums(seen, gone.select("day", "T", "_one"), ["day"], "T", 30, {"cancel_net30": "_one"})
    counts = {c: F.col(c).cast("long") for c in ("net_n15", "cancel_here30", "cancel_net30")}
    seen = seen.withColumn("net_mean15", F.try_divide("_net15", "net_n15")).withColumns(counts)
    return seen.select("day", "vehicle", "pos", "T", *FEATURES, "cancelled_next", "d_next", "delta")


def split_by_period(df: DataFrame, period: str, parts: dict[str, list[int]], longest: float | None = None, run: str = "plan_run") -> DataFrame:
    """``df`` with ``part``: the name of the list that holds the row's ``period``; rows in none, or planned longer than ``longest``, drop out."""
    part = F.lit(None).cast("string")
    for name, numbers in parts.items():
        part = F.when(F.col(period).isin(numbers), name).otherwise(part)
    kept = df.withColumn("part", part).where("part is not null")
    return kept if longest is None else kept.where(F.col(run) <= longest)


def difference_counts(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(column, n, different, only_a, only_b): in how many rows two tables of features differ, NULL being equal to NULL."""
    x, y = a.select(*keys, F.struct(*columns).alias("_a")), b.select(*keys, F.struct(*columns).alias("_b"))
    both = x.join(y, keys, "full")
    kinds = dict(a.dtypes)

    def differs(c: str):
        left, right = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        near = F.abs(left - right) <= tolerance if kinds[c] in ("double", "float") else left == right
        return ~F.coalesce(near, left.isNull() & right.isNull(), F.lit(False))

    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), differs(c).alias("_d")) for c in columns]))
    long = both.withColumn("_c", each).select("_c.*", there.alias("_there"), F.col("_b").isNull().alias("_oa"), F.col("_a").isNull().alias("_ob"))
    return long.groupBy("column").agg(F.count_if("_there").alias("n"), F.count_if(F.col("_there") & F.col("_d")).alias("different"), F.count_if("_oa").alias("only_a"), F.count_if("_ob").alias("only_b"))


def stratified(df: DataFrame, strata: list[str], key: str, each: int, seed: int) -> DataFrame:
    """``each`` rows of every stratum, those of the smallest md5 of seed and key. Ranks are taken within strata, so strata are what is spread."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*strata).orderBy(order, key))).where(F.col("_r") <= each).drop("_r")


def boosted(train: DataFrame, columns: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 1):
    """A gradient-boosted model of a yes-or-no label (Spark ML), NULL features as -99; gives the fitted pipeline, whose ``probability`` is a vector."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    ready = numeric(train, columns).withColumn("_y", F.col(label).cast("double"))
    steps = [VectorAssembler(inputCols=columns, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, seed=seed, subsamplingRate=1.0)]
    return Pipeline(stages=steps).fit(ready)


def boosted_grid(train: DataFrame, columns: list[str], label: str, held: str, grid: list[tuple[int, float]], trees: int = 60, patience: float = 0.005, seed: int = 1) -> tuple[object, DataFrame]:
    """The best of several boosted models by their log loss where the column ``held`` is true, and (depth, step, trees, n, log_loss, chosen) of all.

    Rows with ``held`` stop the fit: boosting ends when their error falls by less than
    ``patience`` of itself, and the trees up to the best are kept (Spark's
    ``validationIndicatorCol``). Features may be null (-99). The rows are written once for all fits.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    ready = materialise(numeric(train.select(*columns, label, held), columns).withColumn("_y", F.col(label).cast("double")), "boosted-rows")
    rows, fitted = [], []
    for depth, step in grid:
        tree = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, subsamplingRate=1.0, validationIndicatorCol=held, validationTol=patience)
        model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), tree]).fit(ready)
        loss = log_loss(model, ready.where(F.col(held)), columns, label)
        rows.append((depth, step, len(model.stages[-1].trees), loss["n"], loss["log_loss"]))
        fitted.append(model)
    best = min(range(len(grid)), key=lambda k: (rows[k][4], k))
    table = train.sparkSession.createDataFrame([(*r, k == best) for k, r in enumerate(rows)], "depth int, step double, trees int, n long, log_loss double, chosen boolean")
    return fitted[best], table


def log_loss(model, rows: DataFrame, columns: list[str], label: str) -> dict:
    """n and mean log loss of a boosted model on rows whose label is known."""
    from pyspark.ml.functions import vector_to_array

    p = model.transform(numeric(rows.select(*columns, label), columns)).withColumn("_p", F.element_at(vector_to_array("probability"), 2))
    kept = F.least(F.greatest(F.col("_p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    return p.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(label).cast("boolean"), -F.log(kept)).otherwise(-F.log(1 - kept))).alias("log_loss")).first().asDict()


def group_log_loss(train: DataFrame, test: DataFrame, by: list[str], label: str, weight: float = 5.0) -> DataFrame:
    """(n, log_loss) on ``test`` of the share of ``label`` in each group of ``train``, drawn to the whole share by ``weight`` rows; unseen groups have the whole share."""
    y = F.col(label).cast("int")
    whole = train.agg(F.avg(y).alias("_all"))
    shares = train.groupBy(*by).agg(F.sum(y).alias("_k"), F.count(F.lit(1)).alias("_n"))
    joined = test.join(shares, by, "left").crossJoin(F.broadcast(whole))  # one row
    p = (F.coalesce("_k", F.lit(0)) + weight * F.col("_all")) / (F.coalesce("_n", F.lit(0)) + weight)
    kept = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(y == 1, -F.log(kept)).otherwise(-F.log(1 - kept))).alias("log_loss"))


def boosted_classes(train: DataFrame, columns: list[str], label: str, trees: int = 5, depth: int = 3, seed: int = 1):
    """One boosted model a class against the rest; ``label`` numbers the classes from 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import VectorAssembler

    ready = numeric(train, columns).withColumn("_y", F.col(label).cast("double"))
    one = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), OneVsRest(classifier=one, featuresCol="_x", labelCol="_y", predictionCol="predicted")]).fit(ready)


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-99.0)) for c in columns})
