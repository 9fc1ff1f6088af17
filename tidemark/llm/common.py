"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: A word: a run of characters other than space and \t \n \v \f \r.
WORD_GAP = r"[ \t-\r]+"

_OWN_DIR: str | None = None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="spark-tidemark-")
    return _OWN_DIR


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(key: DataType, rest: str, name: str = "key") -> StructType:
    """Schema of a key of any type (structs with any field names too) and the columns of a DDL text."""
    return StructType([StructField(name, key), *StructType.fromDDL(rest).fields])


def free_name(taken: list[str], name: str) -> str:
    """name, or with as many underscores as no column, whatever its case, has."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def release() -> None:
    """Give freed memory of a Python worker back to the system: workers live on between tasks, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text (null: none), by built-in functions."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def join_small(big: DataFrame, small: DataFrame, rows: int, on: list[str], limit: int = 100_000, salts: int = 64, salt: str = "salt_key") -> DataFrame:
    """Left join of big to a table of `rows` measured rows, null-safe on `on`.

    Broadcast up to `limit` rows; beyond it, a shuffle join in which each key of `small` is repeated for
    `salts` salts, so that a key with a third of all rows is spread over as many tasks. big[salt] must be a long.
    """
    small = small.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in small.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    if rows <= limit:
        out = big.join(F.broadcast(small), cond, "left")
    else:
        small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        big = big.withColumn("__part", F.pmod(F.col(salt), F.lit(salts)).cast("int"))
        out = big.join(small, [*cond, F.col("__part") == F.col("__salt")], "left").drop("__part", "__salt")
    return out.drop(*[f"__{c}" for c in on])


def slices(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about `most` characters each, so that a task's memory does not follow the batch."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
