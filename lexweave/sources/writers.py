"""Sinks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str) -> None:
    """Parquet by split, so that reading one split reads only its files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


# What Spark's writer calls a null among partition values.
NULL_NAME = "__HIVE_DEFAULT_PARTITION__"


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """One text file per value of the whole-number column ``name``, called ``<name>=<value>``.

    A file has a line for each of its rows, and a null text is an empty line. In a file system mounted
    on all machines a task writes its files itself, into one folder: a folder for each file, as
    Spark's writer makes them elsewhere, costs several processes and a listing task of its own. Files
    get their names when they are complete, so a repeated task replaces what it wrote.
    """
    sc = df.sparkSession.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(sc._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        df.select(name, text).repartition(name).write.partitionBy(name).text(path)
        return
    root = place.toUri().getPath()
    os.makedirs(root)

    def write(rows: Iterator[Row]) -> None:
        task = TaskContext.get()
        folder = os.path.join(root, f"part-{task.partitionId():05d}")
        for value, lines in groupby(rows, lambda row: row[0]):
            os.makedirs(folder, exist_ok=True)
            file = f"{name}={NULL_NAME if value is None else value}.txt"
            held = os.path.join(folder, f".{file}.{task.taskAttemptId()}")
            with open(held, "wb") as out:
                for row in lines:
                    out.write((row[1] or b"") + b"\n")
            os.replace(held, os.path.join(folder, file))

    rows = df.select(name, F.col(text).cast("binary"))
    rows.repartition(name).sortWithinPartitions(name).foreachPartition(write)
