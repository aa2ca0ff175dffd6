"""What the operators share: the cluster's shared folder, written tables, JVM-side words, packed Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bounds of what Spark hands a Python worker at once; Spark's own are 10,000 rows and 64 MB.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def bounded(spark: SparkSession) -> None:
    """Sets ARROW where the session still has Spark's values: long texts make large batches."""
    for key, (default, value) in ARROW.items():
        if spark.conf.get(key, default) in (default, default.rstrip("b")):
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master (one machine, as in tests) gets a folder of its own; a cluster gets an error.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='basalt-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, tag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table written to the shared folder: its lineage is cut and survives lost executors.

    by: columns that partition the table.  Shuffle files of the write are dropped once the table is complete, so that the disk holds one step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0].partition("/kind=")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: A key with a share of 1/HOT of the rows or more is hot, so there are at most HOT hot keys.
HOT = 4096


def hot_keys(counts: DataFrame, key: str, total: int) -> list[int]:
    """The keys of counts (key, n) that hold 1/HOT of total rows or more: at most HOT numbers, whatever the input."""
    return [r[0] for r in counts.where((F.col("n") * HOT >= max(1, total)) & (F.col("n") > 1)).select(key).limit(HOT).collect()]


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], hot: list[int]) -> DataFrame:
    """rows joined with facts (one row per value of keys), so that no task gets all rows of a hot key.

    hot: the hot values of the first key, at most HOT (see hot_keys); their facts are broadcast, so a first key must
    have few.
    """
    if not hot:
        return rows.join(facts, keys)
    is_hot = F.col(keys[0]).isin(hot)
    return rows.where(is_hot).join(F.broadcast(facts.where(is_hot)), keys).unionByName(rows.where(~is_hot).join(facts.where(~is_hot), keys))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column, breaks: str = SPACES) -> Column:
    """The words between breaks, as an array; null gives an empty array."""

    def inner(parts: Column) -> Column:  # only the first and the last part can be empty
        first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        last = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
        return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))

    return let(F.split(F.coalesce(text, F.lit("")), breaks), inner)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once per row however often body names it."""
    return F.transform(F.array(value), body)[0]


def paired(a: Column, b: Column, shift: int, f: Callable[[Column, Column], Column]) -> Column:
    """f(a[i], b[i + shift]) for every i that has both."""
    n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), f)


def windowed(values: Column, k: int, f: Callable[[Column, Column], Column], overlap: bool = False) -> Column:
    """f folded over every k neighbours, in O(log k) passes by doubling.  overlap: f may take an element twice (min)."""

    def grow(have: Column, size: int) -> Column:
        if size == k:
            return have
        if 2 * size <= k:
            return let(paired(have, have, size, f), lambda x: grow(x, 2 * size))
        if overlap:
            return paired(have, have, k - size, f)
        return let(windowed(values, k - size, f), lambda rest: paired(have, rest, size, f))

    return grow(values, 1)


def hash_pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def lesser(a: Column, b: Column) -> Column:
    return F.least(a, b)


# ---- packed batches -------------------------------------------------------------------------------------------


def tidy() -> None:
    """Gives a Python worker's freed memory back, as idle workers stay alive beside the next stage's."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(work: Callable) -> Callable:
    """work, with its worker's freed memory given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        tidy()

    return run


def to_bytes(batch: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(data)) as got:
        return got.read_all()


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches merged, or cut between rows, until each holds about limit bytes of text (a longer text stays whole)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(sizes):
            size += int(n) + 64
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def packed(docs: DataFrame, columns: dict[str, str], limit: int = 6 << 20, tag: str = "packed") -> DataFrame:
    """docs as a written table (batch long, payload binary) of Arrow batches with about limit bytes of text each.

    columns: name in the payload -> name in docs; "text" must be among them.  Written once, so that every later
    step sees the same batches, also after an executor is lost; their numbers hold the writing partition's.
    """
    rows = docs.select(*[F.col(f"`{v}`").alias(k) for k, v in columns.items()])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(chunks(batches, "text", limit)):
            yield pa.RecordBatch.from_pydict({"batch": [first + i], "payload": [to_bytes(batch)]}, schema=schema)

    schema = pa.schema([("batch", pa.int64()), ("payload", pa.binary())])
    return written(rows.mapInArrow(tidied(pack), "batch long, payload binary"), tag)


def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column("batch")[i].as_py(), from_bytes(b.column("payload")[i].as_py())
