"""Read the model's tables from files, the catalog or a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.period import ArgumentError

FILE_FORMATS = ["parquet", "orc", "json", "csv", "avro"]


def read_table(
    spark: SparkSession, location: str, fmt: str = "parquet", schema: T.StructType | None = None, **options: str
) -> DataFrame:
    """A model table from any store; missing model columns read as NULL.

    ``fmt`` is a file format, 'table' for a catalog name or 'jdbc' for a database table
    (``location`` is then the table's name and ``options`` hold url, driver and so on).
    """
    if fmt == "table":
        rows = spark.table(location)
    elif fmt == "jdbc":
        rows = spark.read.format("jdbc").options(dbtable=location, **options).load()
    elif fmt in FILE_FORMATS:
        reader = spark.read.format(fmt).options(**options)
        if schema is not None and fmt in ("json", "csv"):
            reader = reader.schema(schema)
        rows = reader.load(location)
    else:
        raise ArgumentError(f"unknown storage type {fmt!r}", "UNSUPPORTED_STORAGE")
    return conform(rows, schema) if schema is not None else rows


def read_jdbc_partitioned(
    spark: SparkSession, table: str, url: str, *, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """A database table in parallel reads over ranges of its ``id``."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn="id",
            lowerBound=str(low),
            upperBound=str(high),
            numPartitions=str(parts),
            **options,
        )
        .load()
    )


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a model schema: ISO text becomes timestamps, absent columns NULL.

    A date partition column is kept, so that periods still prune.
    """

    def column(field: T.StructField):
        if field.name not in rows.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(field.name)
        stored = rows.schema[field.name].dataType
        if isinstance(field.dataType, T.TimestampNTZType) and isinstance(stored, T.StringType):
            value = F.to_timestamp_ntz(F.regexp_replace(value, "Z$", ""))
        return value.cast(field.dataType).alias(field.name)

    kept = ["event_date"] if "event_date" in rows.columns else []
    return rows.select(*[column(f) for f in schema], *kept)


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw request bodies, one file each, as ``body`` with the file's ``path``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("body"), F.col("_metadata.file_path").alias("path")
    )
