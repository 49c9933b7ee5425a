"""Readers for episode datasets: frames, catalogs, info and annotation documents, manifests, file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trajspark.functions.scalars import episode_index
from trajspark.operators.blocks import explode_range

ANNOTATION = T.StructType([
    T.StructField("episode", T.LongType()), T.StructField("category_id", T.StringType()), T.StructField("template_status", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("frame_indexing", T.StructType([T.StructField("end_frame_exclusive", T.LongType())])),
    T.StructField("segments", T.ArrayType(T.StructType([
        T.StructField("segment_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("start_frame", T.LongType()),
        T.StructField("end_frame_exclusive", T.LongType()), T.StructField("end_frame_inclusive", T.LongType()), T.StructField("num_frames", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("progress", T.StructType([
            T.StructField("method", T.StringType()),
            T.StructField("per_frame", T.ArrayType(T.StructType([T.StructField("frame", T.LongType()), T.StructField("progress", T.DoubleType())])))]))]))),
    T.StructField("_corrupt", T.StringType())])


def read_frames(spark: SparkSession, root: str, columns: list[str], pattern: str | None = None) -> DataFrame:
    """Column-pruned scan with the episode index taken from the file path (NULL when the path names none)."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.parquet(root)
    return df.select(*columns, episode_index(F.col("_metadata.file_path")).alias("episode_index"),
                     F.col("_metadata.file_name").alias("file_name"))


def read_episode_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("episode_index LONG, length LONG").json(path)


def catalog_gaps(catalog: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Catalogued episodes without data."""
    return catalog.join(present.select(key), key, "left_anti")


def read_dataset_info(spark: SparkSession, path: str) -> DataFrame:
    """The single info document: totals, rate, path template and feature shapes."""
    features = "MAP<STRING, STRUCT<dtype: STRING, shape: ARRAY<LONG>>>"
    schema = f"total_episodes LONG, total_frames LONG, fps DOUBLE, data_path STRING, features {features}"
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_annotations(spark: SparkSession, root: str, status: str, prefix: bool = False) -> tuple[DataFrame, DataFrame]:
    """Annotation documents below ``root`` as (segments, skipped files with a reason)."""
    docs = (spark.read.schema(ANNOTATION).option("multiLine", "true").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "checkpoints.json").json(root)
            .withColumn("source", F.col("_metadata.file_path")))
    docs = docs.withColumn("episode", F.coalesce("episode", episode_index(F.col("source"))))
    return split_annotations(docs, status, prefix)


def parse_annotations(df: DataFrame, text: str, source: str, status: str, prefix: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same for documents held in a text column."""
    parsed = df.withColumn("_d", F.from_json(text, ANNOTATION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return split_annotations(parsed.select(F.col(source).alias("source"), "_d.*"), status, prefix)


def split_annotations(docs: DataFrame, status: str, prefix: bool) -> tuple[DataFrame, DataFrame]:
    wanted = F.col("template_status").startswith(status) if prefix else F.col("template_status") == status
    problem = (F.when(F.col("_corrupt").isNotNull(), "unreadable").when(F.coalesce(F.size("segments"), F.lit(0)) <= 0, "no_segments")
               .when(~F.coalesce(wanted, F.lit(False)), "other_status"))
    marked = docs.withColumn("problem", problem)
    kept = marked.where("problem is null").select("source", "episode", "category_id", F.posexplode("segments").alias("pos", "s"))
    return kept.select("source", "episode", "category_id", F.col("pos").cast("long").alias("pos"), "s.*"), marked.where("problem is not null").select("source", "problem")


def per_frame_labels(segments: DataFrame) -> DataFrame:
    return segments.select("episode", "segment_id", F.explode("progress.per_frame").alias("p")).select("episode", "segment_id", "p.*")


def parse_range(text: Column) -> Column:
    """Inclusive range from "a:b", "[a, b]" or {"start": a, "end": b}."""
    numbers = F.regexp_extract_all(text, F.lit(r"(-?\d+)"), 1)
    return F.struct(F.get(numbers, F.lit(0)).cast("long").alias("start"), F.get(numbers, F.lit(1)).cast("long").alias("end"))


def resolve_pools(groups: DataFrame, references: DataFrame, candidates: dict[str, DataFrame], key: str) -> DataFrame:
    """Targets per category from the first source that names any, minus the references.

    ``candidates`` maps a source name to inclusive ranges (category, start, end), in order of precedence; categories no
    source knows use the hull of their references.
    """
    hull = references.groupBy(key).agg(F.min("episode").alias("start"), F.max("episode").alias("end"))
    ranked = None
    for rank, (name, df) in enumerate([*candidates.items(), ("reference_hull", hull)]):
        part = df.select(key, "start", "end", F.lit(rank).alias("rank"), F.lit(name).alias("origin"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.join(groups.select(key), key, "left_semi").groupBy(key).agg(F.min("rank").alias("rank"))
    chosen = ranked.join(best, [key, "rank"])
    pool = explode_range(chosen, [key], "start", "end", "episode").select(key, "origin", "episode").distinct()
    return pool.join(references.select(key, "episode"), [key, "episode"], "left_anti")


def read_prompt_entries(df: DataFrame, text: str) -> DataFrame:
    """Manifest entries held as JSON text; entries without an id are dropped."""
    schema = "prompt_id STRING, category_id STRING, episode_index LONG, paths MAP<STRING, STRING>"
    return df.select(F.from_json(text, schema).alias("e")).select("e.*").where("prompt_id is not null")


def build_prompt_bank(entries: DataFrame, artefacts: dict[str, DataFrame], key: str) -> DataFrame:
    """One package per entry with flags for the artefacts that exist."""
    out = entries
    for name, df in artefacts.items():
        out = out.join(df.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left").withColumn(
            f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return out.withColumn("supports_predicted_width", F.col("has_annotation"))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` with their size, without cache folders; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    path = F.replace(F.regexp_replace("path", r"^file:/*", "/"), F.lit("\\"), F.lit("/"))
    relative = F.when(path.startswith(root.rstrip("/") + "/"), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)
    return files.where(~F.col("path").contains("/.cache/")).select(relative.alias("path"), "size")


def ragged_rows(df: DataFrame, ids: list[str], offsets: str, flat: str) -> DataFrame:
    """Offsets and flat values to one array per row."""
    parts = F.expr(f"transform(sequence(0, size({offsets}) - 2), i -> slice({flat}, cast({offsets}[i] + 1 as int), cast({offsets}[i + 1] - {offsets}[i] as int)))")
    return df.select(*ids, F.posexplode(parts).alias("pos", "values")).withColumn("pos", F.col("pos").cast("long"))


def ragged_offsets(rows: DataFrame, keys: list[str], pos: str, values: str) -> DataFrame:
    """Running offsets of per-row arrays, the reverse of ``ragged_rows``."""
    from trajspark.operators.blocks import running
    summed = running(rows, keys, pos, {"end_offset": ("sum", F.size(values).cast("long"))})
    return summed.withColumn("start_offset", F.col("end_offset") - F.size(values))


def inspect(df: DataFrame, keys: list[str], ts: str, payload: str) -> DataFrame:
    """Rows, time range and presence of the payload per group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.min(F.octet_length(F.col(payload))).cast("long").alias("smallest_payload"), F.count_if(F.col(payload).isNull()).alias("missing_payload"))


def validate_dataset(catalog: DataFrame, frames: DataFrame, required: list[str], vectors: dict[str, int], payload: str) -> DataFrame:
    """Problems per episode: missing columns, length mismatch, wrong vector width, missing payload."""
    missing = [c for c in required if c not in frames.columns]
    checks = [F.count(F.lit(1)).alias("rows")]
    checks += [F.count_if(F.coalesce(F.size(c), F.lit(0)) != width).alias(f"bad_{c}") for c, width in vectors.items()]
    checks += [F.count_if(F.coalesce(F.octet_length(payload), F.lit(0)) == 0).alias("bad_payload")]
    seen = catalog.join(frames.groupBy("episode").agg(*checks), "episode", "left")
    rules = [("missing columns: " + ",".join(missing), F.lit(bool(missing))), ("no data", F.col("rows").isNull()),
             ("length mismatch", F.col("rows") != F.col("length"))]
    rules += [(f"{c} not matrix-shaped", F.col(f"bad_{c}") > 0) for c in vectors] + [("missing payload bytes", F.col("bad_payload") > 0)]
    found = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda x: x.isNotNull())
    return seen.select("episode", F.coalesce("rows", F.lit(0)).alias("frames_checked"), F.explode_outer(found).alias("problem"))
