"""Shared folder, written intermediate tables and text helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtide.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``. Files stay there until their owner removes them."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and a lost executor costs no earlier work.

    The table stays until ``release`` is told that its readers have been written themselves.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Folders of the tables ``saved`` has written and not released."""
    return list(_WRITTEN)


def release(spark: SparkSession, folders: list[str]) -> None:
    """Remove tables of ``saved`` that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(folder)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: Column | str) -> Column:
    """The first 128 bits of the text's SHA-256; equal texts share it."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def words_in(text: Column | str) -> Column:
    """Number of words, runs of other characters than space and the controls 9 to 13. A null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    gaps = F.regexp_replace(text, WORD, "w")
    return F.coalesce(F.length(F.translate(gaps, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("bigint")


def lower_ascii(text: Column | str) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes; a longer document is a range of its own."""
    first, count = 0, offsets.size - 1
    while first < count:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last
