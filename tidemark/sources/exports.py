"""Exports of result frames to files: CSV, JSON lines and Parquet, each written by all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, MapType, StructType, TimestampNTZType, TimestampType


def flat(df: DataFrame) -> DataFrame:
    """Columns that a text file can hold: arrays joined by `;`, structs and maps as JSON, dates and times as ISO text."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
        elif isinstance(t, StructType):
            c = F.to_json(F.struct(*[c[n].alias(n) for n in sorted(t.names)]), {"ignoreNullFields": "false"})
        elif isinstance(t, MapType):
            c = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
        elif isinstance(t, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(t, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """One header a file; an empty frame still writes its header."""
    flat(df).write.option("header", True).option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Keys in sorted order, nulls kept."""
    flat(df).select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).write.option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)
