"""Author growth: each new paper's author follows the inverse-square law of publication counts.

Whether a paper promotes somebody, and from which count, depends on the counts that the papers before it
left, so that decision is sequential. It needs nothing but counts: how many authors have k publications
and how many of them may be promoted. The driver walks these counts and writes one number a paper: a new
author's, or the rank of a member of a publication count in a hashed order. Executors rank the authors
and join. Authors that were promoted or born in the walk are numbers there, eight bytes each.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import u_fast
from ..plans.state import keep, kept_path
from .graph import dense_ids, distributed_rank

#: A number of a member: its publication count times this, plus its rank. Count 0: born in the walk; below 0: named.
COUNT = 1 << 40
#: Papers that are written at once.
PART = 500_000


def draw(*parts: object) -> float:
    """The driver's copy of functions.rng.u: the same number from the same names."""
    text = ":".join(map(str, parts))
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 1) / ((1 << 32) + 1)


class GrowthWalk:
    """Totals by publication count; of those who may be promoted, how many nobody has touched yet, and the touched ones."""

    def __init__(self, totals: dict[int, int], fresh: dict[int, int], lifetime: int, seed: int = 0):
        self.totals = np.zeros(max([64, *(k + 2 for k in totals)]), np.int64)
        for k, n in totals.items():
            self.totals[k] = n
        self.fresh, self.used = dict(fresh), dict.fromkeys(fresh, 0)
        self.members: dict[int, array] = {}
        self.named: dict[int, int] = {}
        self.lifetime, self.seed = lifetime, seed
        self.births = array("i")

    def name(self, author: int, pubs: int, may_be_promoted: bool) -> None:
        """An author that later papers name; those that may be promoted are members of their count as well."""
        self.named[author] = pubs
        if may_be_promoted:
            self.members.setdefault(pubs, array("q")).append(-1 - author)

    def _move(self, member: int, k: int, listed: bool = True) -> None:
        if k + 2 > len(self.totals):
            self.totals = np.concatenate([self.totals, np.zeros(len(self.totals), np.int64)])
        if k:
            self.totals[k] -= 1
        self.totals[k + 1] += 1
        if listed:
            self.members.setdefault(k + 1, array("q")).append(member)

    def deficit(self) -> int | None:
        """The smallest count k >= 2 that is short of more than one author."""
        one = int(self.totals[1])
        top = int((2 * one) ** 0.5) + 2
        if top >= len(self.totals):
            self.totals = np.concatenate([self.totals, np.zeros(top + 1 - len(self.totals), np.int64)])
        for low in range(2, top, 256):  # the first count that is short is a small one, mostly
            k = np.arange(low, min(low + 256, top), dtype=np.int64)
            expected = np.floor(one / (k * k) + 0.5)
            short = np.flatnonzero((expected >= 1) & (expected - self.totals[k] > 1))
            if len(short):
                return int(k[short[0]])
        return None

    def new_year(self, year: int) -> None:
        """Members whose life is over can't be promoted any more; they still count."""
        for k, held in self.members.items():
            ids = np.frombuffer(held, np.int64) if len(held) else np.empty(0, np.int64)
            born = np.frombuffer(self.births, np.int32)
            own = (ids >= 0) & (ids < COUNT)
            gone = np.zeros(len(ids), bool)
            gone[own] = year - born[ids[own]] >= self.lifetime
            if gone.any():
                self.members[k] = array("q", ids[~gone].tobytes())

    def give(self, author: int, may_be_promoted: bool = True) -> int:
        """A paper for a named author; an unknown one is born."""
        k = self.named.get(author, 0)
        held = self.members.get(k)
        listed = may_be_promoted if not k else held is not None and (-1 - author) in held
        if k and listed:
            held.remove(-1 - author)
        self.named[author] = k + 1
        self._move(-1 - author, k, listed)
        return -1 - author

    def next_author(self, year: int, name: object) -> int:
        k = self.deficit()
        if k is not None:
            fresh, held = self.fresh.get(k - 1, 0), self.members.setdefault(k - 1, array("q"))
            if fresh + len(held):
                at = int(draw(self.seed, "author", year, name) * (fresh + len(held)))
                if at < fresh:
                    member = (k - 1) * COUNT + self.used[k - 1]
                    self.fresh[k - 1] -= 1
                    self.used[k - 1] += 1
                else:
                    member, held[at - fresh] = held[at - fresh], held[-1]
                    held.pop()
                if member < 0:
                    self.named[-1 - member] = k
                self._move(member, k - 1)
                return member
        self.births.append(year)
        member = len(self.births) - 1
        self._move(member, 0)
        return member


def _written(spark: SparkSession, members: Iterable[int]) -> DataFrame:
    """idx, member: the walk's numbers, written a part at a time."""
    path = kept_path(spark, f"walk-{uuid.uuid4().hex}")
    schema = "idx long, member long"
    held, start = array("q"), 0

    def flush() -> None:
        nonlocal held, start
        rows = pa.table({"idx": pa.array(np.arange(start, start + len(held))), "member": pa.array(np.frombuffer(held, np.int64) if len(held) else np.empty(0, np.int64))})
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        held, start = array("q"), start + len(held)

    for m in members:
        held.append(m)
        if len(held) == PART:
            flush()
    flush()
    return spark.read.schema(schema).parquet(path)


def _ranked(authors: DataFrame, seed: int) -> DataFrame:
    """author_id, member: the number of each author among those of its publication count, in a hashed order."""
    slotted = authors.withColumn("_u", u_fast("author_rank", "author_id", seed=seed)).withColumn("_slot", F.floor(F.col("_u") * 1024))
    counts = slotted.groupBy("pub_count", "_slot").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("pub_count").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("pub_count", "_slot", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("pub_count", "_slot").orderBy("_u", "author_id")) - 1
    return slotted.withColumn("_n", within).join(starts, ["pub_count", "_slot"]).select("author_id", (F.col("pub_count") * COUNT + F.col("_start") + F.col("_n")).alias("member"))


def grow(agents: DataFrame, authors: DataFrame, year: int, lifetime: int, seed: int = 0, named: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(agent, author_id) for agents(agent) in id order, and authors with the year's papers counted.

    authors(author_id, birth_year, pub_count, cartel_id). named(agent, author_id) are given by name (planted
    lines and scheduled group members: as few as the configuration lists, and they pass through the driver).
    Authors with a cartel_id and those whose life is over are never promoted.
    """
    spark = agents.sparkSession
    order = keep(dense_ids(agents.select(F.col("agent").alias("node_id"))).withColumnRenamed("node_id", "agent"), "order")
    may = F.col("cartel_id").isNull() & (F.lit(year) - F.col("birth_year") < lifetime)
    known = authors.withColumn("_may", may)
    by_place: dict[int, int] = {}
    if named is not None:
        by_place = {r["idx"]: r["author_id"] for r in order.join(named, "agent").select("idx", "author_id").collect()}
        known = known.join(F.broadcast(named.select("author_id").distinct().withColumn("_named", F.lit(True))), "author_id", "left") if by_place else known.withColumn("_named", F.lit(None).cast("boolean"))
    else:
        known = known.withColumn("_named", F.lit(None).cast("boolean"))
    open_ = F.col("_may") & F.col("_named").isNull()
    counts = known.groupBy("pub_count").agg(F.count("*").alias("n"), F.sum(F.when(open_, 1).otherwise(0)).alias("open")).collect()
    walk = GrowthWalk({r["pub_count"]: r["n"] for r in counts}, {r["pub_count"]: r["open"] for r in counts}, lifetime, seed)
    barred = set()
    for r in known.where("_named").collect() if by_place else ():
        walk.name(r["author_id"], r["pub_count"], r["_may"])
        if not r["_may"]:
            barred.add(r["author_id"])
    next_id = 1 + max([authors.agg(F.coalesce(F.max("author_id"), F.lit(-1))).first()[0], *by_place.values()])
    m = order.count()

    def members() -> Iterator[int]:
        for i in range(m):
            yield walk.give(by_place[i], by_place[i] not in barred) if i in by_place else walk.next_author(year, i)

    given = _written(spark, members())
    pool = _ranked(known.where(open_).select("author_id", "pub_count"), seed)
    by_rank = given.where(F.col("member") >= COUNT).join(pool, "member").select("idx", "author_id")
    direct = given.where(F.col("member") < COUNT).select("idx", F.when(F.col("member") < 0, -1 - F.col("member")).otherwise(next_id + F.col("member")).alias("author_id"))
    assigned = keep(by_rank.unionByName(direct).join(order, "idx").select("agent", "author_id"), "assigned")
    more = assigned.groupBy("author_id").agg(F.count("*").alias("more"))
    grown = authors.join(more, "author_id", "full")
    grown = grown.select("author_id", F.coalesce("birth_year", F.lit(year)).cast("int").alias("birth_year"), (F.coalesce("pub_count", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("pub_count"), F.col("cartel_id").cast("int").alias("cartel_id"))
    return assigned, keep(grown, "authors")


def first_authors(nodes: DataFrame, lifetime: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """nodes with author_id, and authors, for nodes(node_id, year, ...) that have none: by the same law in (year,
    id) order from no author at all. The driver sees how many nodes each year has."""
    years = sorted(map(tuple, nodes.groupBy("year").count().collect()))
    walk = GrowthWalk({}, {}, lifetime, seed)

    def members() -> Iterator[int]:
        i = 0
        for year, n in years:
            walk.new_year(year)
            for _ in range(n):
                yield walk.next_author(year, i)
                i += 1

    given = _written(nodes.sparkSession, members())
    spread = nodes.withColumn("_slot", F.col("year").cast("long") * (1 << 40) + F.floor(F.col("node_id") / (1 << 14)))
    order = distributed_rank(spread, F.col("_slot"), "year", "node_id")
    named = keep(order.join(given.withColumnRenamed("member", "author_id"), "idx").drop("idx"), "first_authors")
    authors = named.groupBy("author_id").agg(F.min("year").cast("int").alias("birth_year"), F.count("*").alias("pub_count"), F.lit(None).cast("int").alias("cartel_id"))
    return named, authors
