"""Queries over a trial log: runs of configurations at budgets, with losses and times.

A log has the columns config, budget, loss, started and finished (seconds or timestamps
as doubles), and a sequence ``seq`` that orders runs of equal times. Each query is
declarative; none brings runs to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import group_quantile, running

#: Loss of a run that failed.
FAILED_LOSS = 65535.0


def best_k(log: DataFrame, k: int, tie: str = "seq") -> DataFrame:
    """At the largest budget, the k runs of least loss; ties by ``tie``."""
    top = log.agg(F.max("budget").alias("__b"))
    return log.join(F.broadcast(top), F.col("budget") == F.col("__b")).drop("__b").orderBy("loss", tie).limit(k)


def specific(log: DataFrame, ids: list, key: str = "seq") -> DataFrame:
    return log.where(F.col(key).isin(ids))


def retained(log: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The best n runs of each group; the rest may be deleted."""
    return running(log, by or ["budget"], ["loss", "seq"], {"__k": ("count", F.lit(1))}).where(F.col("__k") <= n).drop("__k")


def next_id(log: DataFrame, key: str = "seq") -> DataFrame:
    """(next_id): one above the largest, 1 for an empty log."""
    return log.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"))


def scan(log: DataFrame, where: dict | None = None, since: float | None = None, order: str = "seq") -> DataFrame:
    """The runs of some values (a list means any of them) that started at or after a time, in order."""
    for c, v in (where or {}).items():
        log = log.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c).eqNullSafe(F.lit(v)))
    return (log if since is None else log.where(F.col("started") >= since)).orderBy(order)


def field_equals(c: str, path: str, value: str):
    """Predicate: a field of a JSON column, by path, has this text."""
    return F.get_json_object(c, path) == F.lit(value)


def running_best(log: DataFrame) -> DataFrame:
    """Each run with the least loss of its budget so far, and how many had finished."""
    return running(log, ["budget"], ["finished", "seq"], {"best": ("min", F.col("loss")), "n_finished": ("count", F.lit(1))})


def incumbent_per_budget(log: DataFrame) -> DataFrame:
    """(budget, config, loss): the first run of least loss."""
    return log.groupBy("budget").agg(F.min_by("config", F.struct("loss", "seq")).alias("config"), F.min("loss").alias("loss"))


def incumbent_trajectory(log: DataFrame, by: str = "experiment") -> DataFrame:
    """Runs that became the incumbent of their experiment: a larger budget than any before, or as large and of less loss."""
    seen = running(log, [by], ["finished", "seq"], {"__b": ("max", F.col("budget"))}, exclusive=True)
    # the least loss so far among the runs of the largest budget so far
    reach = seen.withColumn("__top", F.greatest(F.coalesce("__b", "budget"), "budget"))
    best = running(reach, [by, "__top"], ["finished", "seq"], {"__l": ("min", F.when(F.col("budget") == F.col("__top"), F.col("loss")))}, exclusive=True)
    new = F.col("__b").isNull() | (F.col("budget") > F.col("__b")) | ((F.col("budget") == F.col("__b")) & (F.col("__l").isNull() | (F.col("loss") < F.col("__l"))))
    return best.where(new).drop("__b", "__top", "__l")


def learning_curves(log: DataFrame) -> DataFrame:
    """(config, curve): the (budget, loss) of each configuration, by budget."""
    return log.groupBy("config").agg(F.array_sort(F.collect_list(F.struct("budget", "loss"))).alias("curve"))


def largest_budget_runs(log: DataFrame) -> DataFrame:
    """Each configuration's run at its largest budget; the later one of two."""
    w = Window.partitionBy("config").orderBy(F.desc("budget"), F.desc("seq"))
    return log.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def promoted(log: DataFrame, k: int | Column, by: list[str]) -> DataFrame:
    """Successive halving: of each stage the k runs of least loss go on."""
    ranked = running(log, by, ["loss", "seq"], {"place": ("count", F.lit(1))})
    return ranked.withColumn("place", F.col("place").cast("int")).where(F.col("place") <= k)


def resampled(log: DataFrame, k: int, by: list[str], rate: float = 0.5, least: int = 1) -> DataFrame:
    """Successive resampling: k * (1 - rate) go on, ``least`` at least; the rest is sampled anew."""
    return promoted(log, max(least, int(k * (1 - rate))), by)


def without_gaps(log: DataFrame, by: str = "experiment", longest: float = 0.0) -> DataFrame:
    """Times with the pauses between an experiment's runs taken out."""
    ended = running(log, [by], ["started", "seq"], {"__e": ("max", F.col("finished"))}, exclusive=True)
    gap = F.greatest(F.col("started") - F.col("__e") - longest, F.lit(0.0))
    gaps = ended.withColumn("__g", F.when(F.col("__e").isNull(), 0.0).otherwise(gap))
    off = running(gaps, [by], ["started", "seq"], {"__o": ("sum", F.col("__g"))})
    return off.withColumns({"started": F.col("started") - F.col("__o"), "finished": F.col("finished") - F.col("__o")}).drop("__e", "__g", "__o")


def concurrency(log: DataFrame) -> DataFrame:
    """(moment, n_running) at each time at which a run starts or ends; ends count before starts.

    Changes are summed per moment first; the running sum is over moments.
    """
    change = log.select(F.inline(F.array(F.struct(F.col("started").alias("moment"), F.lit(1).alias("d")), F.struct(F.col("finished").alias("moment"), F.lit(-1).alias("d")))))
    moments = change.groupBy("moment").agg(F.sum("d").alias("d"))
    low, high = moments.agg(F.min("moment"), F.max("moment")).first()
    if low is None:
        return moments.select("moment", F.col("d").alias("n_running"))
    part = F.least(F.floor((F.col("moment") - low) / F.lit(float(high - low) or 1.0) * 256), F.lit(255))
    placed = moments.withColumn("__p", part)
    sums = placed.groupBy("__p").agg(F.sum("d").alias("__s"))
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows at most
    sums = sums.select("__p", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__s"))
    inside = F.sum("d").over(Window.partitionBy("__p").orderBy("moment").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__n", inside).join(F.broadcast(sums), "__p").select("moment", (F.col("__n") + F.col("__s")).alias("n_running"))


def time_range(log: DataFrame, by: str = "experiment") -> DataFrame:
    """(experiment, first_start, last_finish, max_budget, best_loss at that budget)."""
    top = F.max_by(F.struct("budget", (-F.col("loss")).alias("l")), F.struct("budget", (-F.col("loss")).alias("l")))
    one = log.groupBy(by).agg(F.min("started").alias("first_start"), F.max("finished").alias("last_finish"), top.alias("t"))
    return one.select(by, "first_start", "last_finish", F.col("t.budget").alias("max_budget"), (-F.col("t.l")).alias("best_loss"))


def loss_histogram(log: DataFrame, low: float, high: float, bins: int, kind: str = "kind") -> DataFrame:
    """(budget, kind, bin, n): losses in equal bins from 1; 0 and bins + 1 are beyond the ends."""
    return log.groupBy("budget", kind, F.width_bucket("loss", F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def loss_summary(log: DataFrame, by: str = "budget") -> DataFrame:
    """5th percentile, least, most, mean and population deviation of losses."""
    r = lambda c, n: F.round(c, 6).alias(n)
    low = group_quantile(log, [by], "loss", 0.05, "p05").select(F.col(by).alias("__by"), r("p05", "p05"))
    rest = log.groupBy(by).agg(r(F.min("loss"), "least"), r(F.max("loss"), "most"), r(F.avg("loss"), "mean"), r(F.stddev_pop("loss"), "deviation"))
    return rest.join(low, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "p05", "least", "most", "mean", "deviation")


def budget_pairs(log: DataFrame) -> DataFrame:
    """(low, high, a, b): the losses of each configuration at every two budgets it ran at.

    A configuration has few budgets, so pairs are bounded by the square of their number.
    """
    one = log.groupBy("config", "budget").agg(F.avg("loss").alias("loss"))
    x, y = one.toDF("config", "low", "a"), one.toDF("config", "high", "b")
    return x.join(y, "config").where("low < high").select("low", "high", "a", "b")
