"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.session import checkpoint_dir

#: The white space of every contract here: [\x20\x09-\x0D], which is also what
#: bytes.split() and bytes.strip() take without arguments.
BLANKS = b" \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives
    lost executors, and later reads take only the columns they use."""
    spark = df.sparkSession
    path = (f"{checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}/"
            f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete the table that ``settle`` made, once nothing reads it any more."""
    _delete(df.sparkSession, df.settled_at)


def drop_settled(spark: SparkSession) -> None:
    """Delete the settled tables of this application, once its results are written."""
    _delete(spark, f"{checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(id_col: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def byte_slices(batches: Iterator[pa.RecordBatch], column: str,
                most: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most`` bytes in each
    (a single longer value stays whole): memory follows the slice, not the batch."""
    for batch in batches:
        sizes = batch.column(column)
        lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (held + n > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def binary_values(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    return column.cast(pa.binary()).to_pylist()
