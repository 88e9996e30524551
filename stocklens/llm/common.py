"""Helpers shared by the operators: reading, staging, tokens, hashing, code shipping."""

from __future__ import annotations

import functools
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stocklens.session import ensure_checkpoint_dir

# Functions of this package run inside tasks: ship them by value, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MASK64 = (1 << 64) - 1
BATCH_BYTES = 1 << 22      # what a task hands to Python at once, under ``small_batches``


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of ``spark.checkpoint.dir`` and read
    it back: lineage is cut, every use reads the same rows, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``__at``: the place of each row, from 0, among the rows of its ``key`` by
    ``order`` (ties: any order). One range shuffle deals contiguous stretches and is staged;
    a stretch's first place comes from the sizes of the key's earlier stretches, so no task
    holds more of one key than a stretch. A null key is a key."""
    rows = staged(df.withColumn("__tie", F.monotonically_increasing_id())
                    .repartitionByRange(F.col(key), *order, F.col("__tie"))
                    .sortWithinPartitions(F.col(key), *order, F.col("__tie")).drop("__tie")
                    .withColumn("__row", F.monotonically_increasing_id()), name)
    part = F.shiftright("__row", 33)
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (rows.groupBy(F.col(key).alias("__key"), part.alias("__part"))
                  .agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
                  .select("__key", "__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift")))
    return (rows.join(shifts, F.col(key).eqNullSafe(F.col("__key")) & (part == F.col("__part")))
                .withColumn("__at", F.col("__row") + F.col("__shift")).drop("__key", "__part", "__row", "__shift"))


def crc_mod(name: str, m: int) -> Column:
    """crc32 of the value as text, modulo m (a null counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, wherever the optimizer moves it: as a
    lambda's argument it cannot be repeated inside another lambda."""
    return F.transform(F.array(value), body)[0]


def draw(salt: str, *cols: Column) -> Column:
    """A number in [0, 1) from a hash: which rows a bounded sample takes, whatever their order."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(salt)), 11).cast("double") / F.lit(float(1 << 53))


def publish(spark: SparkSession, name: str, parts) -> str:
    """Write ``parts`` (bytes, one after the other) as one file into the shared folder and send
    it to every executor; its name for ``SparkFiles.get``. The driver holds one part at a time."""
    name = f"{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    for part in parts:
        for i in range(0, len(part), 1 << 22):
            out.write(bytearray(part[i:i + (1 << 22)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class Shared:
    """A broadcast of ``value`` with the code of its class, so that executors need no install of
    this package. ``value`` unpacks it: once in a task."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return cloudpickle.loads(self._sent.value)

    def destroy(self) -> None:
        self._sent.destroy()


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 bytes. ``bytes.lower``
    and ``bytes.split`` are exactly these ASCII rules."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordIds(dict):
    """word -> 64-bit id (xxh3), remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 1 << 18):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        v = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = v
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (wrap-around arithmetic), vectorised."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & MASK64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def small_batches(fn):
    """``fn``, whose first argument is a DataFrame, with Arrow batches of about BATCH_BYTES for the
    actions inside it: texts wait in memory on both sides of the pipe, for every task."""
    @functools.wraps(fn)
    def run(df: DataFrame, *args, **options):
        conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        old = conf.get(key, None)
        conf.set(key, str(BATCH_BYTES))
        try:
            return fn(df, *args, **options)
        finally:
            conf.unset(key) if old is None else conf.set(key, old)
    return run


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes, whole rows each; nothing is copied."""
    rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def map_batches(df: DataFrame, fn, schema: str, most: int | None = None) -> DataFrame:
    """``mapInArrow`` with a function from a dict of Python lists to a dict of lists/arrays;
    ``fn`` is a factory called once in each task (worker state lives in its closure). With
    ``most`` it gets pieces of about so many bytes, so a task's lists stay small."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in (b for whole in batches for b in ([whole] if most is None else pieces(whole, most))):
            out = step({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema)

    return df.mapInArrow(run, schema)
