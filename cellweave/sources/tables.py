"""Reading, normalising and writing tables of molecules, pairs and shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cellweave.functions.labels import clean_label
from cellweave.functions.scalars import to_number

MOLECULES = T.StructType([T.StructField("transcript_id", T.LongType()), T.StructField("feature_name", T.StringType()), T.StructField("cell_id", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in "xyz"]])


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """A file, folder or list of them; only the columns asked for are read."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def normalise(df: DataFrame, names: Mapping[str, str] | None = None, nucleus_above: float | None = None) -> DataFrame:
    """Molecules in the fixed types: names maps own columns to ours; labels are cleaned, genes trimmed, numbers made finite or NULL.

    Given nucleus_above, ``overlaps_nucleus`` says whether ``nuclei_probs`` is above it.
    """
    for old, new in (names or {}).items():
        df = df.withColumnRenamed(old, new)
    require(df, ["feature_name", "cell_id", "x", "y"])
    if "transcript_id" not in df.columns:
        raise ValueError("transcript_id is needed: rows have no order to number them by; see number_rows")
    fixed = {"transcript_id": F.col("transcript_id").cast("long"), "feature_name": F.trim(F.col("feature_name").cast("string")), "cell_id": clean_label(F.col("cell_id"))}
    fixed |= {c: to_number(F.col(c)) for c in "xyz" if c in df.columns}
    if "z" not in df.columns:
        fixed["z"] = F.lit(0.0)
    if nucleus_above is not None:
        require(df, ["nuclei_probs"])
        fixed["overlaps_nucleus"] = (F.col("nuclei_probs") > nucleus_above).cast("int")
    return df.withColumns(fixed)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "transcript_id") -> DataFrame:
    """Rows numbered from 0 by the given total order.

    Sorted by range, then counted per partition, so that no task holds all rows.
    """
    from cellweave.util import checkpoint

    part = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33)))
    before = part.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(W.orderBy("__part")) - F.col("n")).drop("n")
    return part.join(before, "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def polygons(vertices: DataFrame, cell: str = "cell_id", order: str = "seq", x: str = "vertex_x", y: str = "vertex_y") -> DataFrame:
    """(cell, ring) of cells with at least three vertices, ring in vertex order."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("s"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return vertices.groupBy(cell).agg(ring.alias("ring")).filter(F.size("ring") >= 3)


def write_chunks(df: DataFrame, path: str, partition: str = "partition") -> DataFrame:
    """Parquet with a folder for each partition; returns the summary of it."""
    df.repartition(partition).write.partitionBy(partition).parquet(path)
    return df.groupBy(partition).agg(F.count("*").alias("n_transcripts"), F.count_distinct("cell_id").alias("n_cells"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def molecules_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as molecules: the table that most queries run on."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    gene = F.concat("event_type", F.lit("_"), (F.get_json_object("props", "$.k").cast("int") % 12).cast("string"))
    cell = F.when(F.col("event_id") % 10 == 0, "-1").otherwise(F.col("user_id").cast("string"))
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select(F.col("event_id").alias("transcript_id"), gene.alias("feature_name"), cell.alias("cell_id"), F.col("value").alias("x"), ((micros % 86400000000) / F.lit(1e6) / F.lit(172.8)).alias("y"), F.dayofmonth("ts").cast("double").alias("z"))
