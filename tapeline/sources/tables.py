"""Batch and streaming readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, path: str, columns: list[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Parquet table, projected so that only the needed columns are read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if columns is None else df.select(*columns)


def read_jdbc(
    spark: SparkSession, url: str, table: str, columns: list[str],
    partition_column: str | None = None, bounds: tuple[str, str] | None = None,
    partitions: int = 16, **options: str,
) -> DataFrame:
    """Database table; filters on the result are pushed into the database.

    With a partition column the read is split into ranges instead of one connection.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
            numPartitions=partitions,
        )
    return reader.load().select(*columns)


def parse_json(
    df: DataFrame, schema: T.StructType, value: str = "value", rescue: str | None = None
) -> DataFrame:
    """JSON text or bytes to the contract's columns; malformed messages become null rows.

    With ``rescue`` a column of that name keeps the text of a message that is no JSON
    object or does not fit the contract, and is null for all others.
    """
    text = F.col(value).cast("string")
    if rescue is None:
        return df.select(F.from_json(text, schema).alias("d")).select("d.*")
    whole = T.StructType([*schema.fields, T.StructField(rescue, T.StringType())])
    parsed = F.from_json(text, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": rescue})
    kept = F.when(F.col("d").isNull(), F.col("m")).otherwise(F.col(f"d.`{rescue}`"))
    return df.select(text.alias("m"), parsed.alias("d")).select(
        *[F.col(f"d.`{f.name}`") for f in schema.fields], kept.alias(rescue)
    )


def read_stream_json(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1,
    rescue: str | None = None,
) -> DataFrame:
    """Topic stand-in: a folder of JSON-line files, a capped number per trigger."""
    raw = (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    )
    return parse_json(raw, schema, rescue=rescue)


def read_stream_kafka(
    spark: SparkSession, servers: str, topic: str, schema: T.StructType, max_offsets: int
) -> DataFrame:
    """Kafka topic from the earliest offset, a capped number of offsets per trigger."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("failOnDataLoss", "false")
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    return parse_json(raw, schema)
