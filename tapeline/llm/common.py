"""What the training-data operators share: words, names, tables written between two steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.session import checkpoint_dir

#: The characters that part words.
SPACE = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(batch: pa.RecordBatch | pa.Table, name: str) -> list[bytes]:
    """A column of texts in UTF-8; a null text is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


_FOLDERS: dict[str, str] = {}


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written under the shared folder and read back.

    This cuts the lineage without keeping anything on one executor, gives the
    optimizer real sizes and lets the next step read only its columns. Every call
    writes a folder of its own, so a repeated run never reads an older table.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = checkpoint_dir(spark).rstrip("/")
    path = f"{_FOLDERS[app]}/tapeline-{app}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of every query that ends inside are removed at its end.

    Otherwise they stay until the driver's JVM happens to collect what refers to them.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cores(spark: SparkSession) -> int:
    """Partitions that a narrow CPU-bound step is dealt over at least."""
    return max(spark.sparkContext.defaultParallelism, 1)
