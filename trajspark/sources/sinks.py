"""Writers and write plans."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Fixed field order; other columns are dropped."""
    df.select(*fields).write.option("header", "true").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def csv_line(fields: list[str]) -> Column:
    return F.to_csv(F.struct(*fields))


def json_line(fields: list[str]) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_plan(targets: DataFrame, existing: DataFrame, manual: DataFrame, key: str, overwrite: bool) -> DataFrame:
    """What happens to each target: manual annotations stay, existing output is skipped or overwritten, the rest is written."""
    has = existing.select(key).distinct().withColumn("_e", F.lit(True))
    own = manual.select(key).distinct().withColumn("_m", F.lit(True))
    status = (F.when(F.col("_m"), "skipped_manual").when(F.col("_e"), "overwritten" if overwrite else "skipped_existing")
              .otherwise("written"))
    return targets.join(has, key, "left").join(own, key, "left").withColumn("status", status).drop("_e", "_m")


def write_episodes(df: DataFrame, path: str, overwrite: bool, partitions: list[str] | None = None) -> None:
    """Refuse a filled output folder unless ``overwrite``; replace only the partitions that get new rows."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partitions:
        writer = writer.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def committed_runs(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of the last commit of an output and the folders that make it up; (0, []) where nothing is committed."""
    try:
        commits = spark.read.schema("number LONG, run STRING").json(f"{path}/commits/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    last = commits.agg(F.max("number")).first()[0]
    return (last, sorted(r.run for r in commits.where(F.col("number") == last).collect())) if last else (0, [])  # a row per kept run


def commit_episodes(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write episodes so that readers see all of a run or none of it; the number of the commit.

    Rows are staged in a folder of their own by Spark's writer. Only when that has ended is a new commit written, a small table that names the
    folders of the output: the new one (``overwrite``), or all so far and the new one (``append``). A run that fails, or is stopped, leaves the
    last commit and its files as they are; of two writers with the same next number, one gets an error. ``errorifexists`` refuses a filled output.
    """
    spark = df.sparkSession
    if mode not in ("errorifexists", "overwrite", "append"):
        raise ValueError(f"unknown mode {mode}")
    number, runs = committed_runs(spark, path)
    if runs and mode == "errorifexists":
        raise ValueError(f"{path} has committed episodes")
    run = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{run}")
    kept = [run] if mode == "overwrite" else [*runs, run]
    rows = spark.createDataFrame([(number + 1, r) for r in kept], "number LONG, run STRING")
    rows.coalesce(1).write.mode("errorifexists").json(f"{path}/commits/{number + 1:010d}")
    return number + 1


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The episodes of the last commit of :func:`commit_episodes`; columns by name over all its runs."""
    _, runs = committed_runs(spark, path)
    if not runs:
        raise ValueError(f"{path} has no committed episodes")
    return spark.read.option("mergeSchema", "true").parquet(*[f"{path}/data/{r}" for r in runs])


def run_summary(df: DataFrame, category: str, episode: str, counts: dict[str, Column]) -> DataFrame:
    """Counts overall, per category and per episode."""
    level = F.when(F.grouping(episode) == 0, "episode").when(F.grouping(category) == 0, "category").otherwise("total")
    return df.groupingSets([[], [category], [category, episode]], category, episode).agg(
        level.alias("level"), F.count(F.lit(1)).alias("frames"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def summary_documents(summary: DataFrame, category: str) -> DataFrame:
    """One JSON document per category line of a run summary; episodes stay in their own table."""
    cols = [c for c in summary.columns if c not in ("level", category)]
    return summary.where("level = 'category'").select(category, F.to_json(F.struct(*cols)).alias("document"))
