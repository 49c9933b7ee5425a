"""What several operators share: inputs, shared storage, exact ranks, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.session import checkpoint_dir, cut_lineage

#: Rows without an id rank behind all others.
NO_ID = 2**63 - 1
#: Bytes of an Arrow batch that a Python step over texts gets; a longer row is a batch of its own.
BATCH = 4 << 20
#: Links of which components are found in one task, with their stars broadcast (a few MB); more are dealt out.
FEW_LINKS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir`` of the session, or, where it is unset (tests on one machine), one below the warehouse."""
    return checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Store a result in the shared folder, so that a lost executor or a later step recomputes nothing before it."""
    return cut_lineage(df)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about :data:`BATCH` bytes for this session: Python then holds little of long texts at a time, whatever their number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def same_columns(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``rows`` with a struct ``_doc`` of a document's columns and its new text, as the columns of ``docs``; n_chars follows the text."""
    out = []
    for f in docs.schema.fields:
        value = F.col("_doc").getField(f.name)
        if f.name == "text":
            value = F.col(text)
        elif f.name == "n_chars" and "text" in docs.columns:
            value = F.length(text).cast(f.dataType)
        out.append(value.alias(f.name))
    return rows.select(*out)


def key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(NO_ID))


def parts(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, group: list[str], order: list, blocks: int = 64, name: str = "rank") -> DataFrame:
    """Number the rows of each group from 0, in an order of hash blocks and by ``order`` within a block; a large group is spread over tasks.

    ``order`` must be total up to rows that are equal in all columns.
    """
    block = F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int")
    df = df.withColumn("_block", block)
    counts = df.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order))
    df = df.withColumn("_inside", inside - 1)
    same = [df[c].eqNullSafe(counts[c]) for c in [*group, "_block"]]
    joined = df.join(counts, same, "left")
    return joined.select(*[df[c] for c in df.columns if c not in ("_block", "_inside")], (F.col("_before") + F.col("_inside")).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (columns a, b), for nodes that have an edge.

    Every round hooks all neighbours of a node, and the node, on the smallest of them (a star), first towards smaller nodes and then
    among them; the number of rounds grows with the logarithm of the longest path. Stars are found by aggregation, so a node with very
    many neighbours is combined before the shuffle. Each round is stored in the shared folder; only a count returns to the driver.
    """
    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = cut(df)
        mark = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return df.coalesce(1 + mark[0] // FEW_LINKS), tuple(mark)  # few links are one task, and its rounds need no shuffle

    def near(stars: DataFrame, count: int) -> DataFrame:
        return F.broadcast(stars) if count <= FEW_LINKS else stars

    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    links, before = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while before[0]:
        both = links.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("l")).select("l.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        down = both.join(near(least, before[0]), F.col("u") == F.col("k")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down, kept = stored(down.distinct())
        low = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = down.join(near(low, kept[0]), F.col("u") == F.col("k"))
        turned = small.select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("l")).select("l.*")
        links, now = stored(turned.where("u <> v").distinct())
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
