"""What several operators share: tables, batch size, freed shuffles, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import give_back, prepare, shared_dir, work_path

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 256  # rows handed to Python at once; keeps a batch of long texts within a worker's memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with batches to Python small enough for long texts."""
    prepare(spark).conf.set(BATCH, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read from there, so a lost executor
    costs no earlier stage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    spark.conf.set(BATCH, str(BATCH_ROWS))
    give_back(spark)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges`` (``a``, ``b``, both long): the smallest
    node that can be reached.

    Alternating stars: every node hands its neighbours the smallest node it knows, first to the larger
    ones, then to the smaller ones, until nothing changes. Minima are aggregated before the shuffle and
    joins are plain equi-joins, which may be split, so a star with a third of all nodes is many tasks.
    Loops and null ends are left out; a node without another end has no row.
    """
    e = (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
         .where("a is not null and b is not null and a <> b").distinct())
    e, mark = cut(e), None
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = (small.select("a", F.col("m").alias("b"))
                 .union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select("b").distinct()
    return e.toDF("node", "root").union(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def put(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written compressed below the shared folder and read from there, and its path, for ``forget``."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete work tables that nothing reads any more."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
