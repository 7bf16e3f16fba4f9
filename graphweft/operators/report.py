"""Summaries of many runs: (algorithm, instance, run, and measured columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.exact import rounded


def require_columns(results: DataFrame, *columns: str) -> DataFrame:
    missing = {"algorithm", "instance", *columns} - set(results.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return results


def best_per_instance(results: DataFrame, x: str = "modularity") -> DataFrame:
    """The largest value of each algorithm on each instance, failed runs (null) left out."""
    return require_columns(results, x).na.drop(subset=[x]).groupBy("algorithm", "instance").agg(F.max(x).alias(x))


def opt_per_instance(results: DataFrame, x: str = "modularity") -> DataFrame:
    return best_per_instance(results, x).groupBy("instance").agg(F.max(x).alias("opt"))


def ratio_to_best(results: DataFrame, x: str = "modularity") -> DataFrame:
    best = best_per_instance(results, x)
    return best.join(best.groupBy("instance").agg(F.max(x).alias("opt")), "instance", "left").select("algorithm", "instance", F.try_divide(F.col(x), F.col("opt")).alias("ratio"))


def performance_profile(results: DataFrame, x: str = "modularity") -> DataFrame:
    """(algorithm, rank, fraction, ratio): ratios in falling order after a first 1.0; one 0.0 where they end, then nulls."""
    ratios = ratio_to_best(results, x)
    ranked = ratios.where("ratio > 0").withColumn("rank", F.row_number().over(Window.partitionBy("algorithm").orderBy(F.desc("ratio"), "instance")))
    solved = ranked.groupBy("algorithm").agg(F.max("rank").alias("solved"))
    size = ratios.agg(F.countDistinct("instance").alias("n"))
    grid = ratios.select("algorithm").distinct().join(size).select("algorithm", "n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("rank"))
    joined = grid.join(ranked.select("algorithm", "rank", "ratio"), ["algorithm", "rank"], "left").join(solved, "algorithm", "left")
    value = F.when(F.col("rank") == 0, F.lit(1.0)).when(F.col("ratio").isNotNull(), F.col("ratio")).when(F.col("rank") == F.coalesce("solved", F.lit(0)) + 1, F.lit(0.0))
    return joined.select("algorithm", "rank", rounded(F.col("rank").cast("double") / F.col("n")).alias("fraction"), rounded(value).alias("ratio"))


def performance_profile_wide(results: DataFrame, x: str = "modularity") -> DataFrame:
    """One row per fraction, one column per algorithm."""
    profile = performance_profile(results, x)
    names = sorted(r["algorithm"] for r in profile.select("algorithm").distinct().collect())
    return profile.groupBy("rank", "fraction").pivot("algorithm", names).agg(F.first("ratio", ignorenulls=True)).drop("rank")


def geomean_summary(results: DataFrame) -> DataFrame:
    """Geometric means of the best quality and of its microseconds an edge, over positive values."""
    best = best_run(results).where("modularity > 0 and time > 0 and edges > 0")
    return best.groupBy("algorithm").agg(
        rounded(F.exp(F.avg(F.ln("modularity"))), 6).alias("quality"), rounded(F.exp(F.avg(F.ln(F.col("time") * 1e6 / F.col("edges")))), 3).alias("us_per_edge"), F.count(F.lit(1)).alias("instances")
    )


def improvement_log(results: DataFrame) -> DataFrame:
    """(algorithm, instance, run, time, modularity) of the runs that beat all before them; runs without a value are no runs.

    One task orders the runs of an algorithm on an instance.
    """
    before = Window.partitionBy("algorithm", "instance").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    best = results.where("modularity is not null").withColumn("best", F.max("modularity").over(before))
    return best.where("best is null or modularity > best").select("algorithm", "instance", "run", "time", "modularity")


def best_run(results: DataFrame) -> DataFrame:
    """The row of the best modularity of each algorithm and instance; the first run of equal ones."""
    rows = require_columns(results, "modularity", "time", "edges", "run").na.drop(subset=["modularity"])
    first = F.max_by(F.struct("run", "modularity", "time", "edges"), F.struct("modularity", -F.col("run")))
    return rows.groupBy("algorithm", "instance").agg(first.alias("b")).select("algorithm", "instance", "b.run", "b.modularity", "b.time", "b.edges")


def speedup(results: DataFrame, low: int = 1, high: int = 16) -> DataFrame:
    """The slowest time with each number of threads, and their ratio."""
    at = lambda n: F.max(F.when(F.col("threads") == n, F.col("time")))
    times = results.groupBy("algorithm", "instance").agg(at(low).alias("t_low"), at(high).alias("t_high"))
    return times.select("algorithm", "instance", "t_low", "t_high", rounded(F.try_divide(F.col("t_low"), F.col("t_high")), 6).alias("speedup"))


def memory_table(results: DataFrame) -> DataFrame:
    """The peak memory of each algorithm, from KB to a readable unit."""
    peak = results.groupBy("algorithm").agg(F.max("memory").alias("kb"))
    kb = F.col("kb")
    text = F.when(kb >= 1 << 20, F.format_string("%d GB", F.floor(kb / (1 << 20)))).when(kb >= 1 << 10, F.format_string("%d MB", F.floor(kb / (1 << 10)))).otherwise(F.format_string("%d KB", kb))
    return peak.select("algorithm", "kb", text.alias("memory"))


def run_status(results: DataFrame, time_limit: float, memory_limit_kb: int) -> DataFrame:
    """TLE past one and a half of the time limit, MLE past the memory limit, FAIL without a result, else OK."""
    status = F.when(F.col("time") > 1.5 * time_limit, "TLE").when(F.col("memory") > memory_limit_kb, "MLE").when(F.col("modularity").isNull(), "FAIL").otherwise("OK")
    return results.select("algorithm", "instance", "run", status.alias("status"))
