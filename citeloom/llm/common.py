"""Helpers shared by the corpus operators: reading tables, cutting lineage, streaming groups."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.state import keep, kept_path  # noqa: F401  operators take them from here

#: White space as the corpus contracts define it: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: Rows of two or three longs that may be broadcast: 2 million stay under 64 MB.
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where the counted rows are within the limit; else a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def spread_join(rows: DataFrame, groups: DataFrame, key: str, n: str, how: str = "inner", hot: int = 5_000) -> DataFrame:
    """rows joined with groups(key, n, ...) by key, where n is how many rows a key has. Keys of more than hot rows are
    broadcast, so that no task gets all rows of one; there are rows / hot of them at most, and their number is checked."""
    many = keep(groups.where(F.col(n) > hot), "many")
    count = many.count()
    if not count or count > 500_000:
        return rows.join(groups, key, how)
    others = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(groups.where(F.col(n) <= hot), key, how)
    return others.unionByName(rows.join(F.broadcast(many), key))


#: Rows and bytes of an Arrow batch. Long texts make Spark's 10,000 rows too many for small executors.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches where the session still has Spark's defaults. Queries and the pipeline's stages call this;
    operators leave the caller's session as it is."""
    for key, default, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864", BATCH_BYTES)):
        _bound(spark, f"spark.sql.execution.arrow.{key}", default, ours)


#: Rows that Spark's Parquet reader decodes at once. Its 4,096 whole texts fill arrays of many MB, which make the heap grow.
READ_ROWS = 256


def small_reads(spark: SparkSession) -> None:
    """Bound the batches of Spark's Parquet reader where the session still has the default."""
    _bound(spark, "spark.sql.parquet.columnarReaderBatchSize", "4096", READ_ROWS)


def _bound(spark: SparkSession, name: str, default: str, ours: int) -> None:
    if str(spark.conf.get(name, default)).rstrip("b") == default:
        spark.conf.set(name, str(ours))


def release_memory() -> None:
    """Hand freed memory back to the system: workers are used again by later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, schema: str, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """mapInArrow with per-task state: work() runs once in each task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        step = work()
        for batch in batches:
            out = step(batch)
            if out is not None:
                yield out
            del batch, out
        del step
        release_memory()

    return df.mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], order: list[str], schema: str, work: Callable[[pa.Table], pa.Table | None], partitions: int | None = None) -> DataFrame:
    """Call work with all rows of each key, many groups to a batch.

    Rows are dealt and sorted by key, so a task holds one group at a time. Callers bound the size of
    groups by putting a chunk number in the key.
    """
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    wanted = dealt.sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            start = 0
            rows = list(zip(*columns, strict=True))
            for i, key in enumerate(rows):
                if key != current:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        out = work(pa.Table.from_batches(held))
                        if out is not None and out.num_rows:
                            yield from out.combine_chunks().to_batches()
                    held, start, current = [], i, key
            if start < len(rows):
                held.append(batch.slice(start))
        if held:
            out = work(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches()

    return wanted.mapInArrow(run, schema)


def fold_pages(pages: DataFrame, key: str, schema: str, start: Callable[[], object], add: Callable[[object, dict], object], finish: Callable[[object], bytes]) -> DataFrame:
    """Merge the rows of each page one after another; a task holds one merged page, never all rows.

    schema names the key and the merged binary column.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([finish(held)], pa.binary())], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row[key] != current:
                    if held is not None:
                        yield out()
                    current, held = row[key], start()
                held = add(held, row)
        if held is not None:
            yield out()

    return pages.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def joined_spans(spans: list[tuple[int, int, int, str]]) -> str:
    """kind:start:end by start, then the kind's rank; spans hold (start, rank, end, kind)."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))
