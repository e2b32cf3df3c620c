"""Where the tables of one URL set lie, and how they are read and written."""

from __future__ import annotations

import csv
import uuid
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pathloom.scale import cut_lineage, fits_broadcast
from pathloom.schemas import CLUSTERED_URLS, LABELS, RANKED_URLS, SPLIT_URLS, URLS, WORD_VECTORS


def _read_csv(spark: SparkSession, path: str | list[str], schema: StructType, mode: str, corrupt_column: str | None) -> DataFrame:
    if corrupt_column is None:
        return spark.read.csv(path, schema=schema, header=True, mode=mode)
    with_corrupt = StructType([*schema.fields, StructField(corrupt_column, StringType())])
    return spark.read.csv(path, schema=with_corrupt, header=True, mode=mode, columnNameOfCorruptRecord=corrupt_column)


def read_urls(spark: SparkSession, path: str, mode: str = "PERMISSIVE", corrupt_column: str | None = None) -> DataFrame:
    """``id, url`` from CSV with a header.

    An unquoted comma ends the URL and an id that is no number becomes null. ``mode`` is the reader's, so ``FAILFAST``
    refuses such rows and ``DROPMALFORMED`` skips them; ``corrupt_column`` keeps their text in one more column.
    """
    return _read_csv(spark, path, URLS, mode, corrupt_column)


def read_labels(spark: SparkSession, path: str, mode: str = "PERMISSIVE", corrupt_column: str | None = None) -> DataFrame:
    """``id, label`` from CSV whose headers name them, in any order and beside any other columns. The files of a folder may differ in that.

    ``mode`` and ``corrupt_column`` as in :func:`read_urls`. A file without one of the columns is an error.
    """
    kinds = {field.name: field.dataType for field in LABELS}
    kept = [field.name for field in LABELS] + ([corrupt_column] if corrupt_column else [])
    tables = []
    for header, files in _files_by_header(spark, path).items():
        missing = [name for name in kinds if name not in header]
        if missing:
            raise ValueError(f"{files[0]} has no column {' and '.join(missing)}, only {', '.join(header)}")
        schema = StructType([StructField(name, kinds.get(name, StringType())) for name in header])
        tables.append(_read_csv(spark, files, schema, mode, corrupt_column).select(*kept))
    if not tables:
        return spark.createDataFrame([], LABELS)
    return reduce(DataFrame.unionByName, tables)


def _files_by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The CSV files below ``path`` by the columns that their first lines name."""
    # One row for each file, which is what a header is read from.
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header")).orderBy("file").collect()
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first:
        names = tuple(name.strip() for name in next(csv.reader([row["header"]])))
        found.setdefault(names, []).append(unquote(row["file"]))
    return found


@dataclass(frozen=True)
class Quarantined:
    """``rows`` fit for use, and ``rejects (file, line, reason)`` for the others."""

    rows: DataFrame
    rejects: DataFrame


def quarantine(spark: SparkSession, path: str, schema: StructType = URLS) -> Quarantined:
    """Read CSV with a header and part the rows that can be used from those that cannot: lines that are not of ``schema``, rows with a null or empty
    id or first value, and ids that several rows have (all of them). The source is parsed once and kept in the checkpoint folder; both parts
    together hold every line."""
    key, value = schema.fields[0].name, schema.fields[1].name
    with_line = StructType([*schema.fields, StructField("_line", StringType())])
    read = spark.read.csv(path, schema=with_line, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
    rows = read.withColumn("_file", F.input_file_name())
    reason = (
        F.when(F.col("_line").isNotNull(), F.lit("malformed"))
        .when(F.col(key).isNull(), F.lit(f"no {key}"))
        .when(F.col(value).isNull() | (F.col(value) == ""), F.lit(f"no {value}"))
    )
    marked = cut_lineage(rows.withColumn("_reason", reason))
    # Only ids that repeat are gathered, and of those only the id.
    usable = marked.where("_reason is null")
    repeated = cut_lineage(usable.groupBy(key).count().where("count > 1").select(key))
    keys = F.broadcast(repeated) if fits_broadcast(repeated, key, 0) else repeated
    as_line = F.coalesce("_line", F.to_csv(F.struct(*[f.name for f in schema.fields])))
    twice = usable.join(keys, key, "left_semi").withColumn("_reason", F.lit(f"{key} repeats"))
    rejects = marked.where("_reason is not null").unionByName(twice).select(F.col("_file").alias("file"), as_line.alias("line"), F.col("_reason").alias("reason"))
    return Quarantined(usable.join(keys, key, "left_anti").select(*[f.name for f in schema.fields]), rejects)


def require_unique_ids(urls: DataFrame) -> DataFrame:
    """``urls`` itself, or an error that names an ``id`` with several rows. Costs one aggregate over the ids."""
    repeated = urls.groupBy("id").count().where(F.col("count") > 1).first()
    if repeated is not None:
        raise ValueError(f"id {repeated['id']} has {repeated['count']} rows")
    return urls


_POINTERS = StructType([StructField("version", LongType()), StructField("folder", StringType())])


class VersionedTable:
    """A table whose replacement is all or nothing.

    Every write goes to a folder of its own. Only when it is complete, one row that names the folder is appended to the table of pointers, which
    Spark commits by renaming one file; readers take the row with the highest version. A write that fails leaves a folder that no pointer names. Of
    two writers at a time, the one with the higher folder name counts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        """:param path: may end with ``column=value``, the slice of a larger table that this one is."""
        self.spark, self.path, self.schema = spark, path, schema

    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_POINTERS).parquet(f"{self.path}/pointers")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _current(self) -> tuple[int, str] | None:
        pointers = self._pointers()
        return None if pointers is None else pointers.orderBy(F.desc("version"), F.desc("folder")).first()

    def write(self, table: DataFrame) -> None:
        last = self._current()
        version = 1 if last is None else last[0] + 1
        folder = f"version-{version}-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{folder}")
        pointer = self.spark.createDataFrame([(version, folder)], _POINTERS)
        pointer.coalesce(1).write.mode("append").parquet(f"{self.path}/pointers")

    def read(self) -> DataFrame:
        """The rows of the last complete write. It is an error if there is none."""
        current = self._current()
        if current is None:
            raise FileNotFoundError(f"no table has been written to {self.path}")
        folder, (parent, _, name) = f"{self.path}/{current[1]}", self.path.rpartition("/")
        column, _, value = name.partition("=")
        if not value:
            return self.spark.read.schema(self.schema).parquet(folder)
        with_slice = StructType([*self.schema.fields, StructField(column, StringType())])
        rows = self.spark.read.schema(with_slice).option("basePath", parent).parquet(folder)
        return rows.where(F.col(column) == value).drop(column)

    def empty_old_versions(self) -> int:
        """Replace all versions but the current one by empty tables and tell how many there were. No reader of theirs may be left."""
        pointers, current = self._pointers(), self._current()
        old = [] if pointers is None else [r["folder"] for r in pointers.where(F.col("folder") != current[1]).select("folder").distinct().collect()]
        for folder in old:
            self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        return len(old)


@dataclass(frozen=True)
class UrlStore:
    """Versioned Parquet tables of one URL set below ``root``. Word vectors are apart by window size and clustered URLs by
    algorithm, so that one slice is replaced or read without touching the others."""

    root: str

    def table(self, spark: SparkSession, name: str) -> VersionedTable:
        """``split_urls``, ``ranked_urls``, ``word_vectors/window_size=N`` or ``clustered_urls/algorithm=NAME``."""
        schemas = {"split_urls": SPLIT_URLS, "ranked_urls": RANKED_URLS, "word_vectors": WORD_VECTORS, "clustered_urls": CLUSTERED_URLS}
        return VersionedTable(spark, f"{self.root}/{name}", schemas[name.split("/")[0]])

    def _write(self, table: DataFrame, name: str) -> None:
        self.table(table.sparkSession, name).write(table)

    def write_split_urls(self, split: DataFrame) -> None:
        self._write(split, "split_urls")

    def read_split_urls(self, spark: SparkSession) -> DataFrame:
        return self.table(spark, "split_urls").read()

    def write_ranked_urls(self, ranked: DataFrame) -> None:
        self._write(ranked, "ranked_urls")

    def read_ranked_urls(self, spark: SparkSession) -> DataFrame:
        return self.table(spark, "ranked_urls").read()

    def write_word_vectors(self, vectors: DataFrame, window_size: int) -> None:
        self._write(vectors, f"word_vectors/window_size={window_size}")

    def read_word_vectors(self, spark: SparkSession, window_size: int) -> DataFrame:
        return self.table(spark, f"word_vectors/window_size={window_size}").read()

    def write_clustered_urls(self, clustered: DataFrame, algorithm: str) -> None:
        self._write(clustered, f"clustered_urls/algorithm={algorithm}")

    def read_clustered_urls(self, spark: SparkSession, algorithm: str) -> DataFrame:
        return self.table(spark, f"clustered_urls/algorithm={algorithm}").read()
