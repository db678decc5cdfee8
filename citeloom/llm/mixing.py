"""Mixing sources to target weights, to the word.

Every document gets a hash-random key (md5 of its id, source and text, and a seed). Within a source the documents lie in
key order, dealt over ranges of the key; keys are uniform, so fixed ranges are even however large a
source is. Word counts are summed by range, ranges are summed before one another, and within a range a
running sum finishes the distributed prefix sum. A source's budget is its target in whole words: it
repeats all its documents for as many whole epochs as fit, then takes documents in key order up to the
exact word, so that the last one may be taken in part.

Targets: sources in code point order (null last) weigh weights[0], weights[1], ... in turn and share
`share` times all words; none gets over `most` times its words, and what is above is shared out again.

Null and empty texts have size 0 and are never taken. A source without words has target 0. The key is
made of id, source and text, so rows that share an id, or have none, spread like all others; equal rows
follow one another. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, arrow_map, broadcast_if_small, keep, text_or_empty

#: Documents of a key range, about.
RANGE = 2_000
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE.encode())] = True


def count_words(text: bytes) -> int:
    """Runs of [^\\x20\\x09-\\x0D]."""
    if len(text) < 1 << 20:
        return len(text.split())
    inside = ~_SPACE[np.frombuffer(text, np.uint8)]
    return int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def word_counts(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size and key."""

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [count_words(t.as_buffer().to_pybytes()) for t in batch.column(3)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), batch.column(2)], names=["doc_id", "source", "size", "key"])

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), row_key(seed).alias("key"), text_or_empty().alias("text"))
    return arrow_map(rows, "doc_id long, source string, size long, key string", work)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size, target. share: a fraction of all words; targets are filled like linked vessels."""
    over, under = share
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("everything", F.sum("source_size").over(everything) * over)
    by_fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "turn")
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    left = F.col("everything") - F.col("full") * under  # words to share out, times under
    s = s.withColumn("left", left).withColumn("capped", F.col("cap") * under * F.col("open") <= F.col("left") * F.col("weight"))
    s = s.withColumn("first", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "turn", "left", "open"))).over(everything))
    level = (F.col("first.left") * F.col("weight")).cast("double") / (F.col("first.open") * under).cast("double")
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def row_key(seed: str) -> Column:
    """The random key of a row; only equal rows share one."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "source")]
    return F.md5(F.concat_ws(":", *shown, F.md5(text_or_empty()), F.lit(seed)))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole takes), part (words of a last take), taken and key."""
    sizes = keep(word_counts(docs, seed), "sizes")
    goal = keep(targets(sizes, weights, share, most), "targets")
    n_sources = goal.count()
    ranges = max(1, math.ceil(sizes.count() / RANGE))
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("int")
    g = F.broadcast(goal) if n_sources <= 100_000 else goal
    rows = sizes.withColumn("range", place).join(g.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")))
    sums = sizes.withColumn("range", place).groupBy(F.col("source").alias("range_source"), F.col("range").alias("at")).agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("range_source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("range_source", "at", F.coalesce(ahead, F.lit(0)).alias("start"))
    rows = rows.join(broadcast_if_small(starts, min(n_sources * ranges, 1 << 40), 200_000), F.col("source").eqNullSafe(F.col("range_source")) & (F.col("range") == F.col("at")))
    within = F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.col("start") + F.coalesce(within, F.lit(0))).withColumn("budget", F.floor("target"))
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before"))).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "key")


def first_words(text: bytes, n: int) -> bytes:
    """The text up to the end of its nth word."""
    inside = np.zeros(len(text) + 1, bool)
    inside[:-1] = ~_SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return text if n >= len(ends) else text[: ends[n - 1]] if n > 0 else b""


def mixed_documents(docs: DataFrame, mixed: DataFrame, columns: tuple[str, ...], seed: str = "mix") -> DataFrame:
    """The mix itself: a row for each whole take of a document, and one with its first words for a part.

    columns are those of docs to return, doc_id, text, source and n_chars among them; seed is that of the mix.
    Equal rows (one key) are taken as often as all of them together: their takes stand on one of them, the
    one with the least other columns.
    """
    some = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.col("part"))
    whole = F.col("epochs") + F.when((F.col("part") > 0) & (F.col("part") == F.col("size")), 1).otherwise(0)
    taken = mixed.where("taken > 0").groupBy(F.col("key").alias("_key")).agg(F.sum(whole).alias("_whole"), F.max(some).alias("_part"))
    taken = keep(taken, "taken")
    alike = mixed.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1").select("_key")
    rows = docs.select(*columns, row_key(seed).alias("_key"))
    alike = keep(alike, "alike")
    n_alike = alike.count()
    if n_alike:
        few = broadcast_if_small(alike, n_alike, 500_000)
        once = rows.join(few, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*columns)).alias("o")).select(*(F.col(f"o.{c}").alias(c) for c in columns), "_key")
        rows = rows.join(few, "_key", "left_anti").unionByName(once)
    rows = rows.join(broadcast_if_small(taken, taken.count(), 500_000), "_key")
    rows = rows.withColumn("_take", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_whole") + F.when(F.col("_part") > 0, 1).otherwise(0))))
    rows = rows.select(*columns, F.when(F.col("_take") > F.col("_whole"), F.col("_part")).alias("_words"))

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = columns.index("text")
            words = batch.column(len(columns)).to_pylist()
            texts = [None if t is None else t if n is None else first_words(t.encode(), n).decode() for t, n in zip(batch.column(at).to_pylist(), words, strict=True)]
            made = [batch.column(i) for i in range(len(columns))]
            made[at] = pa.array(texts, pa.string())
            return pa.RecordBatch.from_arrays(made, names=list(columns))

        return step

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return arrow_map(rows, schema, work).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


MIX_SQL = r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                 md5(coalesce(doc_id::varchar, 'null') || ':' || coalesce(source, 'null') || ':' || md5(coalesce(text, '')) || ':mix') as key from documents),
  s0 as (select source, sum(size)::bigint as source_size from sized group by source),
  s1 as (select *, row_number() over (order by source asc nulls last) - 1 as turn from s0),
  s2 as (select *, ([5, 2, 1])[turn % 3 + 1]::bigint as weight, source_size * 2 as cap, (sum(source_size) over ())::bigint * 3 as everything from s1),
  s3 as (select *, coalesce(sum(cap) over (order by cap / weight, turn rows between unbounded preceding and 1 preceding), 0)::bigint as full_before,
           (sum(weight) over (order by cap / weight, turn rows between current row and unbounded following))::bigint as open from s2),
  s4 as (select *, everything - full_before * 2 as words_left from s3),
  s5 as (select *, cap * 2 * open <= words_left * weight as capped from s4),
  f as (select words_left as l, open as o from s5 where not capped order by cap / weight, turn limit 1),
  goal as (select source, source_size, case when capped then cap::double else (l * weight)::double / (o * 2)::double end as target from s5 left join f on true),
  r as (select doc_id, size, source_size, target, floor(target)::bigint as budget,
          coalesce(sum(size) over (partition by sized.source order by key, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
        from sized join goal on sized.source is not distinct from goal.source),
  e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from r)
select doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, budget - epochs * source_size - before)))::bigint as taken from e
"""
