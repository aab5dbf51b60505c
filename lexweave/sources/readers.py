"""Tables and documents from files."""

from __future__ import annotations

import codecs
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DatasetConfig, ReadConfig
from ..functions.text import strip
from ..operators.prep import preprocess
from ..operators.ranking import KEY, Running, running, segmented
from ..operators.split import split, union_splits
from ..session import scratch_path
from . import quoted

# Texts a delimited file may use for a missing value.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Bytes of small files that one task reads.
TASK_BYTES = 16 << 20


def charset(encoding: str) -> str:
    """Spark's name of an encoding; unknown ones are left to the session's charset setting."""
    try:
        name = codecs.lookup(encoding).name
    except LookupError:
        return encoding
    # Names that differ.
    return {"iso8859-1": "ISO-8859-1", "ascii": "US-ASCII"}.get(name, name)


def read_table(
    spark: SparkSession,
    path: str,
    cfg: ReadConfig = ReadConfig(),
    schema: T.StructType | str | None = None,
    tree: dict | None = None,
    row_id: str | None = None,
    file_column: str | None = None,
) -> DataFrame:
    """Delimited or JSON-lines files. Columns are text unless a schema is given.

    Quoted fields may hold quotes and line breaks; with ``multiline=False`` they may not
    hold line breaks. Files are read in splits either way (see ``quoted``). One task reads a
    whole file only where its encoding isn't ASCII beyond, or quotes stand in unquoted fields.
    With ``row_id`` there is a column of that name that rises with file and place, and
    ``file_column`` names the file.
    """
    if cfg.fmt in ("json", "jsonl"):
        reader = spark.read.options(encoding=charset(cfg.encoding), primitivesAsString=True, **(tree or {}))
        df = (reader.schema(schema) if schema else reader).json(path)
        more = _places(df, row_id, file_column)
    elif cfg.fmt in ("csv", "tsv"):
        delimiter = "\t" if cfg.fmt == "tsv" or cfg.delimiter == "\\t" else cfg.delimiter
        reader = spark.read.options(
            sep=delimiter,
            encoding=charset(cfg.encoding),
            header=cfg.header,
            multiLine=cfg.multiline,
            quote='"',
            escape='"',
            **(tree or {}),
        )
        df = (reader.schema(schema) if schema else reader).csv(path)
        found = None
        if cfg.multiline and charset(cfg.encoding).lower() in quoted.SPLITTABLE and len(delimiter) == 1:
            found = quoted.records(spark, path, delimiter, charset(cfg.encoding).lower(), cfg.header, tree)
        if found is None:
            more = _places(df, row_id, file_column)
        else:
            # The header was read for its names; the records are parsed one by one.
            options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true"}
            df = quoted.parsed(found, df.schema, options)
            more = [F.col(c).alias(n) for c, n in (("__row_id", row_id), ("__file", file_column)) if n]
            df = df.select(*more, *(F.col(f"`{c}`") for c in df.columns[2:]))
            more = [F.col(n) for n in (row_id, file_column) if n]
    else:
        raise ValueError(f"unknown format {cfg.fmt!r}")
    extra = [n for n in (row_id, file_column) if n]
    columns = [c for c in df.columns if c not in extra]
    names = cfg.names or columns
    df = df.select(*more, *(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)))
    return as_missing(df, cfg.na_values, extra) if cfg.na_values else df


def _places(df: DataFrame, row_id: str | None, file_column: str | None) -> list[Column]:
    """Row ids in scan order and the file's name, for a table straight from its scan."""
    more = [F.monotonically_increasing_id().alias(row_id)] if row_id else []
    return more + ([F.col("_metadata.file_path").alias(file_column)] if file_column else [])


def as_missing(df: DataFrame, na_values: tuple[str, ...] = NA_VALUES, but: Sequence[str] = ()) -> DataFrame:
    """Turn the given texts into nulls in every text column ``but`` some."""

    def value(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.StringType) or f.name in but:
            return c
        return F.when(~c.isin(*na_values), c).alias(f.name)

    return df.select(*(value(f) for f in df.schema.fields))


def load_dataset(spark: SparkSession, cfg: DatasetConfig) -> DataFrame:
    """Read, check, clean and split one dataset; adds a ``split`` column."""
    if not cfg.train_file:
        raise ValueError("a dataset needs a train file")
    train = read_table(spark, cfg.train_file, cfg.read)
    cfg.columns.validate(train.columns)
    if cfg.val_file or cfg.test_file:
        others = [read_table(spark, p, cfg.read) if p else None for p in (cfg.val_file, cfg.test_file)]
        parts = [df and preprocess(df, cfg.columns, cfg.prep) for df in (train, *others)]
        return union_splits(*parts)
    if not by_content(cfg):
        train = read_table(spark, cfg.train_file, cfg.read, row_id="row_id")
    # Cleaned and made distinct once; the passes of the split read the stored rows.
    path = scratch_path(spark, "cleaned")
    identified(train, cfg).write.parquet(path)
    rows = spark.read.schema(identified(train, cfg).schema).parquet(path)
    return split(rows, ["row_id"], cfg.split).drop("row_id")


def by_content(cfg: DatasetConfig) -> bool:
    """Whether rows are identified by what they hold. Where copies stay or file order matters, by their place."""
    return cfg.prep.drop_duplicates and cfg.split.shuffle


def identified(df: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """Cleaned rows with a unique ``row_id``, which ``df`` has already unless rows go by content."""
    if by_content(cfg):
        rows = preprocess(df, cfg.columns, cfg.prep)
        texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in rows.columns]
        return rows.withColumn("row_id", F.sha2(F.to_json(F.array(*texts)), 256))
    keep_copies = replace(cfg.prep, drop_duplicates=False)
    rows = preprocess(df, cfg.columns, keep_copies)
    if cfg.prep.drop_duplicates:
        content = [F.col(f"`{c}`") for c in rows.columns if c != "row_id"]
        rows = rows.groupBy(*content).agg(F.min("row_id").alias("row_id"))
    return rows


def read_text_docs(spark: SparkSession, path: str, tree: dict | None = None) -> DataFrame:
    """One document per file: content and metadata with its source."""
    return gathered(spark.read.options(**(tree or {})).text(path, wholetext=True).select(
        F.col("value").alias("content"),
        F.create_map(F.lit("source"), F.col("_metadata.file_path")).alias("metadata"),
    ))


def gathered(files: DataFrame) -> DataFrame:
    """Whole small files in fewer tasks; Spark takes each for several MB, and so plans a task for a few dozen."""
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return files.coalesce(tasks) if tasks < files.rdd.getNumPartitions() else files


def row_documents(df: DataFrame, names: list[str]) -> DataFrame:
    """Add ``content``: one ``name: value`` line per column."""
    lines = [
        F.concat(F.lit(f"{n}: "), F.coalesce(strip(F.col(f"`{n}`").cast("string")), F.lit("")))
        for n in names
    ]
    return df.withColumn("content", F.concat_ws("\n", *lines))


def read_csv_docs(
    spark: SparkSession, path: str, cfg: ReadConfig = ReadConfig(), **options
) -> DataFrame:
    """One document per row: content and metadata with source and 0-based row in the file."""
    table = read_table(spark, path, cfg, row_id="__id", file_column="__source", **options)
    # Ids have the split in their high bits: a segment is a split.
    marked = segmented(table, ["__source"], F.shiftright("__id", quoted.RECORD_BITS))
    placed = running(marked, ["__source"], [F.col("__id")], {"__row": Running("count", F.lit(1))}).drop(KEY)
    columns = [c for c in table.columns if c not in ("__id", "__source")]
    metadata = F.create_map(
        F.lit("source"), F.col("__source"), F.lit("row"), (F.col("__row") - 1).cast("string")
    )
    return row_documents(placed, columns).select("content", metadata.alias("metadata"))


def load_documents(spark: SparkSession, path: str, file_type: str = "txt") -> DataFrame:
    """A file, or every file of the type anywhere below a directory."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(place)
    if not found:
        raise ValueError(f"no file or directory at {path}")
    tree = {} if all(f.isFile() for f in found) else {"recursiveFileLookup": True, "pathGlobFilter": f"*.{file_type}"}
    if file_type == "csv":
        return read_csv_docs(spark, path, tree=tree)
    return read_text_docs(spark, path, tree)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as bytes by path; nothing is decoded."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", "length", "content"
    )


def attach_images(messages: DataFrame, images: DataFrame, paths: str = "images") -> DataFrame:
    """One row per image reference, with the file's size where it exists."""
    refs = messages.withColumn("image", F.explode(paths))
    return refs.join(images.withColumnRenamed("path", "image"), "image", "left")
