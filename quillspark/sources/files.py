"""Files in and out: BibTeX text, JSON titles, ordered delimited tables, and a Spark data source `bibtex`."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.casing import to_sentence_case
from ..operators.parse import entries_as_json, field_table, read
from ..options import Options


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file (doc_id: its path, text), whatever its extension; one task reads many small files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_fields(spark: SparkSession, path: str | list[str], options: Options | None = None, **more) -> DataFrame:
    """The long table of fields of files at any path that Spark can read."""
    return field_table(read_text(spark, path), options, **more)


def sentence_cased(column, *, guess: bool = True):
    """Column function: a plain title in sentence case, Arrow-batched."""

    @F.pandas_udf("string")
    def convert(titles):
        return titles.map(lambda t: None if t is None else to_sentence_case(t, guess=guess))

    return convert(column)


def read_titles(spark: SparkSession, path: str | list[str], *, guess: bool = True) -> DataFrame:
    """title and its sentence case for every item of JSON files like {"items": [{"title": ...}]}."""
    schema = "items array<struct<title:string>>"
    items = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("items").alias("i"))
    return items.select(F.col("i.title").alias("title"), sentence_cased(F.col("i.title"), guess=guess).alias("sentence"))


def delimited(text: str, separator: str, source: str) -> Iterator[tuple[int, str, str]]:
    """(row, full, abbr) of a headerless table; a row that has not two columns, as a blank line, is an error."""
    for n, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=separator)):
        if len(row) < 2:
            raise ValueError(f"{source}: row {n + 1} has {len(row)} of two columns")
        yield n, row[0], row[1]


def read_ordered_csv(spark: SparkSession, paths: list[str], *, separator: str = ";") -> DataFrame:
    """full, abbr, source, load_ord, row_ord of headerless files, read in the order given; blank lines and short rows are errors.

    A quoted value may hold line ends, so a file is read as a whole, many files at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = path.rstrip("/").rsplit("/", 1)[-1]
                rows = list(delimited(text, separator, source))
                for at in range(0, len(rows), 50_000):
                    n, full, abbr = zip(*rows[at : at + 50_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.string()), pa.array(abbr, pa.string()), pa.array([source] * len(n)), pa.array(n, pa.int64())], names=["full", "abbr", "source", "row_ord"])

    out = None
    for n, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), "value").mapInArrow(run, "full string, abbr string, source string, row_ord long")
        one = one.select("full", "abbr", "source", F.lit(n).alias("load_ord"), "row_ord")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "full string, abbr string, source string, load_ord int, row_ord long")


def write_ordered_csv(merged: DataFrame, path: str, *, separator: str = ";") -> None:
    """abbr;full;source in order of insertion; range-sorted files, whose names are in order too."""
    merged.orderBy("pos").select("abbr", "full", "source").write.mode("overwrite").csv(path, sep=separator, escape='"', emptyValue="")


def write_golden(parsed: DataFrame, path: str) -> None:
    """One line of JSON per document, keys sorted at every depth, entries with maps of fields and modes: a form to compare by."""
    entries_as_json(parsed).write.mode("overwrite").text(path)


#: Bytes and files that one partition of the data source reads at most; one file is never cut.
PACK_BYTES, PACK_FILES = 32 << 20, 1000


class BibtexSource(DataSource):
    """spark.read.format("bibtex"): the long table of fields of a file or all files of a folder; options as in Options, and `fields`.

    Paths are local or URIs of a store that Arrow's file systems know (file, hdfs, s3, gs, abfs); for any other that Spark
    can read there is `read_fields`.
    """

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return "doc_id string, ord int, type string, key string, pos int, name string, mode string, value string, list array<string>"

    def reader(self, schema) -> "BibtexReader":
        return BibtexReader(dict(self.options))


def file_system(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def packs(files: list[tuple[str, int]]) -> list[list[str]]:
    """Runs of (path, bytes) of bounded size."""
    out: list[list[str]] = []
    size = 0
    for path, n in files:
        if not out or size + n > PACK_BYTES or len(out[-1]) >= PACK_FILES:
            out.append([])
            size = 0
        out[-1].append(path)
        size += n
    return out


class BibtexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        known = {k: options[k] for k in ("sentencecase", "caseprotection", "unsupported", "mode") if k in options}
        flags = {k: options.get(k, "false").lower() == "true" for k in ("preservequoted", "inherit")}
        self.options = Options.merged(known | flags | {"fields": tuple(filter(None, options.get("fields", "").split(",")))})

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = file_system(self.path)
        if system.get_file_info(path).type == fs.FileType.Directory:
            inside = system.get_file_info(fs.FileSelector(path))
            files = sorted((i.path, i.size) for i in inside if i.is_file and not i.base_name.startswith(("_", ".")))
        else:
            files = [(path, 0)]
        return [InputPartition(p) for p in packs(files)]

    def read(self, partition: InputPartition):
        system, _ = file_system(self.path)
        for path in partition.value:
            with system.open_input_stream(path) as f:
                record = read(f.read().decode("utf-8", "replace"), self.options)
            for n, e in enumerate(record.entries):
                for x in e.fields.values():
                    yield path, n, e.type, e.key, x.pos, x.name, x.mode, x.value, x.items


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BibtexSource)
