"""What the operators share: table access, shared tables, batches of texts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch are worked on in slices of about this many bytes.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of our own
    only where that is unset and all tasks run in this machine's one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def write_shared(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: cuts the
    lineage, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_shared(df: DataFrame) -> None:
    """Delete the files of a table of ``write_shared`` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_folder(spark)
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if root.split(":")[-1].strip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the bitmap of maybe_in; 32 kbit a row, so its broadcast has 8 MB at most.
BITMAP_BITS = 1 << 26


def maybe_marked(df: DataFrame, column: str, ids: DataFrame, into: str) -> DataFrame:
    """``df`` with a boolean ``into``: whether ``column`` may be among ``ids`` (one column);
    true for all that are, and some others.  What is broadcast is a bitmap of fixed
    size, whatever the number of ids.  A null is among no ids."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS)) + 1
    own = ids.select(F.col(ids.columns[0]).alias("_id")).where("_id IS NOT NULL").select(bit(F.col("_id")).alias("_bit"))
    rows = own.groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    at = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    keyed = df.withColumn("_bit", F.when(F.col(column).isNotNull(), bit(F.col(column)))).withColumn("_bucket", F.bitmap_bucket_number("_bit"))
    found = keyed.join(F.broadcast(rows), "_bucket", "left")
    return found.select(*df.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(into))


def maybe_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``ids`` (one column): all that are,
    and some others.  Saves shuffling the others' texts in the join that follows."""
    return maybe_marked(df, column, ids, "_maybe").where("_maybe").select(*df.columns)


def trimmed(run):
    """``run``, a function of mapInArrow; once a task is through, what it has freed goes
    back to the system, so that reused workers hold no memory of earlier tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim:
            trim(0)

    return whole


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE_BYTES of ``column``, so that a batch of
    very long texts isn't held several times over."""
    n = batch.num_rows
    if n:
        step = max(1, int(n * SLICE_BYTES / max(1, batch.column(column).nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)
