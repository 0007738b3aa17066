"""What the operators of this subpackage share: reading tables, the shared folder, text batches."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Java form of the white-space delimited word of the contracts. bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows are handed to the Python side of an operator in blocks of about so many bytes of text.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only, so that the result doesn't depend on locale or Unicode version."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))


class Scratch:
    """Tables in the folder that driver and executors share (spark.checkpoint.dir).

    Cutting lineage this way survives lost executors: whatever is written is on the shared store, and
    whatever isn't can be computed again from the inputs.
    """

    def __init__(self, spark: SparkSession, name: str):
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            top = "/tmp/docaudit-shared"  # driver and executors are one process here, as in tests
        self.spark, self.top, self.n = spark, f"{top.rstrip('/')}/docaudit-{name}-{uuid.uuid4().hex}", 0
        self.written: set[str] = set()

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.written.add(path)
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Tables of one schema as one scan, so that plans don't grow with their number."""
        return self.spark.read.schema(tables[0].schema).parquet(*(t._scratch_path for t in tables))

    def keep(self, *tables: DataFrame) -> None:
        """Frees every table written so far but these: nothing that is still to be computed may read the others."""
        stay = {t._scratch_path for t in tables}
        for name in self.written - stay:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.written &= stay


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a block holds one row, or several with at most `limit` bytes of text."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # a worker goes on to other stages


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a block as UTF-8; null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b or b"" for b in col.cast(kind).to_pylist()]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
