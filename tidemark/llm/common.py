"""Helpers shared by the text operators: whole texts, keys, shared intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, written

#: ASCII white space other than the blank itself; words are runs of anything else.
ASCII_WS = "\t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(column: str | Column) -> Column:
    """The whole text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """ASCII-white-space separated words in order, repeats included."""
    flat = F.translate(text, ASCII_WS, " " * len(ASCII_WS))
    return F.array_remove(F.split(flat, " "), "")


def row_key(*columns: Column) -> Column:
    """A key of 128 bits (two hashes) for equal rows, nulls told apart from every text; it names a row without an order
    over the table."""
    parts = [x for c in columns for x in (c.isNull(), c.cast("string"))]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("h"), F.xxhash64(F.lit(2), *parts).alias("i"))


KEY = "struct<h:bigint,i:bigint>"


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, for columns that are added for a while."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def once(keyed: DataFrame, repeated: DataFrame, key: str = "key") -> DataFrame:
    """One row of each key. Only the rows of the keys in ``repeated`` (key), which has all that repeat, are shuffled."""
    if not repeated.limit(1).count():
        return keyed
    many = sized_join(keyed, repeated, key, "left_semi").dropDuplicates([key])
    return sized_join(keyed, repeated, key, "left_anti").unionByName(many)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    return written(df, name)


def input_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns, whatever their names, never meet the operators' own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Rows (narrow: a key, at most a few spans) that a join may broadcast. Above it both sides are shuffled.
BROADCAST_ROWS = 200_000


def sized_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str, rows: int | None = None) -> DataFrame:
    """Join with ``small`` (written already), broadcast only if its counted rows are within the bound."""
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


#: What jobs on whole texts and other long rows hold at once: bytes sent to a Python worker (Spark's own bound is 64 MB, which
#: the JVM holds several times, and the worker too) and rows that Spark's Parquet reader decodes (its own: 4,096).
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 64}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hold few long rows at once; what the caller has set stays as it is."""
    ours = {k: v for k, v in SMALL.items() if k not in spark.conf.getAll}
    try:
        for k, v in ours.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k in ours:
            spark.conf.unset(k)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first columns (as many as keys, long, never null): the rows of one key after the other, each
    column in one chunk. One group is in memory at a time."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        if not b.num_rows:
            continue
        values = [b.column(k).to_numpy() for k in range(keys)]
        if held and any(held[-1].column(k)[-1].as_py() != values[k][0] for k in range(keys)):
            yield whole()
            held = []
        new = np.zeros(b.num_rows - 1, bool)
        for v in values:
            new |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            held.append(b.slice(s, e - s))
            if e < b.num_rows:
                yield whole()
                held = []
    if held:
        yield whole()
