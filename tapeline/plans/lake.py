"""Source tables of a folder, and stored intermediate tables.

The reference pipeline stores its tables between jobs. Queries here do the same with
the few tables that many jobs read: each is written once per application under the
shared checkpoint folder and read back, which also cuts the lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeline.session import checkpoint_dir
from tapeline.sources.tables import read_table

_stored: dict[tuple[str, str, str], str] = {}
_roots: dict[str, str] = {}


def source(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", list(columns) or None)


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The named table of this application and folder, written on first use."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if key not in _stored:
        root = _roots.setdefault(app, f"{checkpoint_dir(spark)}/tapeline-{app}")
        path = f"{root}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])
