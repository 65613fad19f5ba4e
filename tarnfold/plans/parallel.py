"""Parallel reading of tables that lie in few files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are fewer than those; otherwise as it is.

    A file of one row group is read by one task however many cores wait. Dealing its rows out costs a
    shuffle of a few files at most; a table of many files, as large ones are, is never shuffled here.
    Filters and column choices still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
