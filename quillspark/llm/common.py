"""What several operators share: scratch tables in the shared folder, word rules, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: Words are runs of anything but these bytes; bytes.split() without an argument cuts at just these.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_local: dict[str, str] = {}
__all__ = ["BATCH", "LOWER", "Scratch", "as_bytes", "crc_mod", "drop", "fresh", "join_copies", "map_batches", "map_rows", "schema_of", "shared_dir", "stage", "table", "tidy_after", "words"]


def words(text: bytes) -> list[bytes]:
    """The words of UTF-8 text with A-Z lowered."""
    return text.translate(LOWER).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where the session names none and runs in one process (tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base and not spark.sparkContext.master.startswith("local") or not base and "local-cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _local:
        _local[app] = f"{(base or 'file://' + tempfile.mkdtemp(prefix='quill-')).rstrip('/')}/quill-{app}"
        atexit.register(drop, spark, _local[app])
    return _local[app]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; harmless when it or the session is gone."""
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        pass


_made: dict[str, list[str]] = {}


def stage(fn):
    """A step of a chain each of which is written before the next begins: what the step before left is deleted first."""

    def run(spark: SparkSession, *rest):
        app = spark.sparkContext.applicationId
        for path in _made.pop(app, []):
            drop(spark, path)
        Scratch.log = made = []
        try:
            return fn(spark, *rest)
        finally:
            Scratch.log = None
            _made[app] = made

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column has, whatever its case: the given ones, with as many underscores as that takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def schema_of(df: DataFrame, *more: str) -> str:
    """The columns' names and types, and some more, as map_rows takes them."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema), *more])


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no more than the running stage."""

    log: list[str] | None = None

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        self.paths.setdefault(name, []).append(path)
        if Scratch.log is not None:
            Scratch.log.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of jobs that have ended and whose results are stored."""
        gc.collect()
        self.spark._jvm.System.gc()

    def forget(self, name: str, but: int = 0) -> None:
        """Delete all but the newest `but` tables kept under a name."""
        old = self.paths.get(name, [])
        for path in old[: len(old) - but]:
            drop(self.spark, path)
        self.paths[name] = old[len(old) - but :]


#: A value that more than this share of all rows have is hot; there are at most 1 / HOT of them.
HOT = 1e-4


def join_copies(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the facts (one row per key, with the number of its rows in `copies`) of their key; both are stored tables.

    At most 10,000 keys can have more than a ten-thousandth of all rows each; their facts are broadcast, so no task
    gets a hot key's rows. The others are joined by a shuffle.
    """
    total = facts.agg(F.sum("copies").alias("n")).first()["n"] or 0
    hot, cold = facts.where(F.col("copies") > HOT * total).drop("copies"), facts.where(F.col("copies") <= HOT * total).drop("copies")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


#: Bytes of an Arrow batch, in place of Spark's default of 64 MB, of which a worker holds several copies at a time.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of few bytes (unless the session has set their size itself) that leaves no memory behind."""
    if df.sparkSession.conf.get(BATCH) == f"{64 << 20}b":
        df.sparkSession.conf.set(BATCH, str(BATCH_BYTES))
    return df.mapInArrow(tidied(fn), schema)


def tidy() -> None:
    """Give memory that a task no longer needs back to the machine, as the worker goes on to others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy_after(fn: Callable, *given):
    try:
        return fn(*given)
    finally:
        tidy()


def tidied(fn: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function of mapInArrow that tidies up at its end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            tidy()

    return run


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Strings of an Arrow column as UTF-8, without decoding them."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, *, binary: tuple[str, ...] = (), flush: int = 4 << 20, limit: int = 20_000) -> DataFrame:
    """mapInArrow over row tuples: fn turns an iterator of rows into one of rows.

    Columns named in `binary` come as UTF-8 bytes. What fn yields is sent on whenever its byte and string
    values reach `flush` bytes or `limit` rows, so that memory does not follow the size of a partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names, out = df.columns, to_arrow_schema(_parse_datatype_string(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(as_bytes(batch.column(i)) if n in binary else batch.column(i).to_pylist() for i, n in enumerate(names)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in fn(rows(batches)):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (bytes, str, list)))
            if size >= flush or len(held) >= limit:
                yield batch_of(held, out)
                held, size = [], 0
        if held:
            yield batch_of(held, out)

    return map_batches(df, run, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def crc_mod(column: str, n: int):
    """crc32 of an id as text, modulo n; a null id counts as the text `null`."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % n
