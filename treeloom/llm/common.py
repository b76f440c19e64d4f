"""Helpers shared by the text operators: table access, durable intermediate tables, word rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, on one machine, one under the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folder under the shared one that tables go to at present.
_FOLDER: ContextVar[str] = ContextVar("folder", default="")


def run_dir(spark: SparkSession) -> str:
    """The folder that tables are stored in at present: one of this application's, which can be deleted as a whole."""
    return f"{shared_dir(spark)}/treeloom-{spark.sparkContext.applicationId}{_FOLDER.get()}"


def discard(spark: SparkSession, path: str | None = None) -> None:
    """Deletes a folder of stored tables, or all of this application; what still reads one of them fails afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path or run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end: for work whose result has been written elsewhere by then."""
    token = _FOLDER.set(f"{_FOLDER.get()}/scratch-{uuid.uuid4().hex}")
    path = run_dir(spark)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        discard(spark, path)


def compact(df: DataFrame, size: str = "large") -> DataFrame:
    """df in fewer partitions, for writing: small files cost more than they hold.

    large: tables as long as the input, a quarter of the usual partitions, but eight for each core at least. medium: such
    tables without texts, a sixteenth, but two for each core at least. small: tables far smaller than the texts, a sixteenth,
    but one for each core at least. few: some thousands of rows at most, one partition.
    """
    spark = df.sparkSession
    cores, usual = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce({"large": max(8 * cores, usual // 4), "medium": max(2 * cores, usual // 16), "small": max(cores, usual // 16), "few": 1}[size])


def stored(df: DataFrame, name: str, size: str = "large", folder: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and outlives any executor."""
    spark = df.sparkSession
    path = f"{folder or run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    compact(df, size).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Documents in an Arrow batch, where the session leaves it at its own 10,000: texts can be long, and a batch is held whole.
BATCH_ROWS = 1000


def short_batches(docs: DataFrame) -> DataFrame:
    """docs, for mapInArrow over its texts: sees to it that the session's batches are short."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return docs


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """True for the documents that no model may learn from: crc32 of the id as text, modulo folds, is 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % F.lit(folds) == 0, F.lit(False))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element array binds it to a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join) -> Column:
    """The running fold of an array of whole numbers from 0 on: element k is join over the elements up to k.

    join is associative and leaves a number as it is when the other one is 0. A fold that appends copies its result at every
    step, so long arrays are folded in about sqrt(n) blocks of as many elements each: n * sqrt(n) steps in all.
    """
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")

    def inner(block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            now = join(acc["last"], x)
            return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(block, F.struct(zero.alias("last"), none.alias("out")), step)["out"]

    def in_blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: inner(F.slice(v, b * width + 1, width)))
        before = lambda p: F.concat(F.array(zero), inner(F.transform(p, lambda x: F.element_at(x, -1))))
        moved = lambda p: let(before(p), lambda o: F.transform(p, lambda x, i: F.transform(x, lambda y: join(F.get(o, i), y))))
        return F.flatten(let(parts, moved))

    return let(F.transform(values, lambda x: x.cast("bigint")), lambda v: F.when(F.size(v) <= 64, inner(v)).otherwise(in_blocks(v)))


def words_of(text: Column) -> Column:
    """The words of a text, in order; an empty array for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def window_hashes(words: Column, width: int) -> Column:
    """A hash for every window of width words, in order, for arrays of at least width words.

    Hashes of single words are combined by doubling, so a window costs a few steps and not width of them.
    """
    n = F.size(words)

    def step(reach: int, h: Column, done: Column | None, length: int) -> Column:
        """h: hashes of windows of reach words; done: of the length words that the lower bits of width stand for."""
        if width & reach:
            joined = h if done is None else F.zip_with(done, F.slice(h, length + 1, n), lambda x, y: F.xxhash64(x, y))
            if reach * 2 > width:
                return F.slice(joined, 1, n - (width - 1))
            return let(joined, lambda d: double(reach, h, d, length + reach))
        return double(reach, h, done, length)

    def double(reach: int, h: Column, done: Column | None, length: int) -> Column:
        twice = F.zip_with(h, F.slice(h, reach + 1, n), lambda x, y: F.xxhash64(x, y))
        return let(twice, lambda t: step(reach * 2, t, done, length))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: step(1, h, None, 0))
