"""Catalog sources (SRC-05) and input caching (CCH-02)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, name: str, fmt: str | None = None,
               options: Mapping[str, str] | None = None) -> DataFrame:
    """SRC-05: a table by ``namespace.name``, or a format with options."""
    if fmt is None:
        return spark.table(name)
    return spark.read.format(fmt).options(**(options or {})).load()


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """CCH-01/CCH-02: keep ``df`` for reuse inside the block, then release it.

    Memory-and-disk so a lost executor's blocks are recomputed from lineage
    rather than failing, and large inputs spill instead of evicting.
    """
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
