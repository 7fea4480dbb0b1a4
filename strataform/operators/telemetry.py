"""Alerts, running statistics, rates, gates and forecasts over measurements in order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataform.functions.scalars import finite, ratio
from strataform.operators.ordered import at_place, over_range

OPERATIONS = {">": lambda v, th: v > th, ">=": lambda v, th: v >= th, "<": lambda v, th: v < th, "<=": lambda v, th: v <= th, "==": lambda v, th: v == th}


def cleared(value: Column, op: str, threshold: float, margin: float) -> Column:
    """Whether a value has left an alert's range by its margin."""
    if op[0] == ">":
        return value < threshold * (1 - margin)
    return value > threshold * (1 + margin) if op[0] == "<" else value != threshold


def alerts(df: DataFrame, key: str, t: str, value: str, op: str = ">", threshold: float = 0.0, consecutive: int = 1, margin: float = 0.0) -> DataFrame:
    """(key, first_t, last_t, peak, n, cleared_at) of each alert.

    An alert opens after `consecutive` triggered samples in a row, counts the triggered samples from there on, and
    closes at the first sample that has left the range by the margin. Values that are null or not finite change
    nothing. A sample that clears is never a triggered one, so clears cut a key's series into parts of one alert at
    most, and window functions do the rest.
    """
    own = df.filter(finite(F.col(value))).select(F.col(key).alias("key"), F.col(t).alias("t"), F.col(value).alias("v"))
    own = own.withColumn("hit", OPERATIONS[op](F.col("v"), F.lit(threshold))).withColumn("clear", ~F.col("hit") & cleared(F.col("v"), op, threshold, margin))
    order = Window.partitionBy("key").orderBy("t")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("part", F.coalesce(F.sum(F.col("clear").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("miss", F.sum((~F.col("hit")).cast("int")).over(so_far))
    own = own.withColumn("run", F.sum(F.col("hit").cast("int")).over(Window.partitionBy("key", "miss").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("opens", F.col("hit") & (F.col("run") >= consecutive))
    own = own.withColumn("open", F.max(F.col("opens").cast("int")).over(Window.partitionBy("key", "part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)) == 1)
    on = F.col("opens")
    peak = {">": F.max(F.when(on, F.col("v"))), "<": F.min(F.when(on, F.col("v")))}.get(op[0], F.min_by("v", F.when(on, F.col("t"))))
    return (
        own.groupBy("key", "part").agg(F.min(F.when(on, F.col("t"))).alias("first_t"), F.max(F.when(on, F.col("t"))).alias("last_t"), peak.alias("peak"), F.count_if(on).alias("n"), F.max(F.when(F.col("clear") & F.col("open"), F.col("t"))).alias("cleared_at"))
        .filter("first_t IS NOT NULL").drop("part")
    )


def last_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    back = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= n).drop("_n")


def recent_count(df: DataFrame, key: str, at: Column, span: int) -> DataFrame:
    """df with n_recent and mean_recent of `value` over the closed range of `span` units up to each row."""
    return over_range(df, key, at, span, lambda w: {"n_recent": F.count(F.lit(1)).over(w), "mean_recent": F.avg("value").over(w)})


def moments(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with the running mean and sample variance (1 for a single value) and the distance of the value from the mean in deviations (0 for a single value)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n, mean, var = F.count(value).over(w), F.avg(value).over(w), F.coalesce(F.var_samp(value).over(w), F.lit(1.0))
    return df.withColumns({"run_n": n, "run_mean": mean, "run_var": var}).withColumn("sigma", F.when(F.col("run_n") < 2, 0.0).otherwise(F.abs(F.col(value) - F.col("run_mean")) / F.sqrt(F.greatest(F.col("run_var"), F.lit(1e-9)))))


def compare(a: DataFrame, b: DataFrame, key: str, metrics: dict[str, bool], tie: float = 0.01) -> DataFrame:
    """(key, metric, a, b, ratio, winner) for each metric of two sides; a metric's value says whether more is better. Within the tie band neither wins; a ratio to 0 is null."""
    rows = lambda df, name: df.select(F.col(key), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("x")).select(key, "x.*")
    both = rows(a, "a").join(rows(b, "b"), [key, "metric"])
    up = F.col("metric").isin([m for m, more in metrics.items() if more])
    share = F.when(F.col("a") != 0, F.col("b") / F.col("a"))
    near = F.abs(F.col("b") - F.col("a")) <= tie * F.greatest(F.abs("a"), F.abs("b"))
    return both.withColumn("ratio", share).withColumn("winner", F.when(near, "tie").when((F.col("b") > F.col("a")) == up, "b").otherwise("a"))


def floor_percentile(df: DataFrame, key: str, value: str, q: float, style: str = "floor") -> DataFrame:
    """(key, p): the value at position floor(q * (n - 1)) in order ("floor"), or floor(q * n), the last at most ("index")."""
    return at_place(df, key, value, (lambda n: F.floor(F.lit(q) * (n - 1))) if style == "floor" else (lambda n: F.least(F.floor(F.lit(q) * n), n - 1)))


def confusion(df: DataFrame, truth: Column, alert: Column) -> DataFrame:
    """Counts, false-positive rate and balanced accuracy."""
    counts = df.agg(F.count_if(truth & alert).alias("tp"), F.count_if(~truth & alert).alias("fp"), F.count_if(~truth & ~alert).alias("tn"), F.count_if(truth & ~alert).alias("fn"))
    tpr, tnr = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return counts.withColumns({"fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn")), "balanced_accuracy": (tpr + tnr) / 2})


def forecast(df: DataFrame, key: str, order: list[str], value: str, steps: int, back: int = 3, damping: float = 1.0) -> DataFrame:
    """(key, step, forecast) from each key's last value and its slope over `back` rows before, damped at each step; keys with fewer rows have a slope of 0."""
    w = Window.partitionBy(key).orderBy(*order)
    own = df.withColumn("_slope", (F.col(value) - F.lag(value, back).over(w)) / back).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))).filter("_n = 1")
    ahead = lambda i: i if damping == 1.0 else (F.lit(damping) * (1 - F.pow(F.lit(damping), i)) / (1 - damping))
    rows = own.select(key, F.col(value).alias("_last"), F.coalesce("_slope", F.lit(0.0)).alias("_slope"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return rows.select(key, "step", (F.col("_last") + F.col("_slope") * ahead(F.col("step"))).alias("forecast"))


def latest_before(df: DataFrame, asked: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """asked with the value of the newest row of df of the same key that isn't later: both sides in one order, the last value carried on."""
    a = df.select(key, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(asked.schema["ask_id"].dataType).alias("ask_id"))
    b = asked.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(df.schema[value].dataType).alias("_value"), "ask_id")
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("found", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1").select("ask_id", key, F.col("_at").alias(at), "found")
