"""Exact dedup against immutable segments behind binary-fuse filters.

Every batch leaves one segment that is never written again: its new digests (digest, copies, largest id)
dealt into buckets, a static 3-wise binary-fuse filter for each bucket (about 9 bits a digest, no false
negatives, 1 in 256 false positives), and its repeats: digests that an earlier segment holds. An incoming
batch is grouped by digest on its own first. Its distinct digests meet the filters of the segments before
it, not their rows; negatives of all of them are new. Positives, and they alone, are joined with the rows
of the segment's hit buckets, which tells copies from false positives. Then the texts of all rows in
groups of two or more are compared byte by byte with the text of the row that stays; rows that differ in
spite of an equal digest are grouped by their texts.

Null counts as an empty text. Rows that share both doc_id and text are one document and stay or go
together. A null doc_id stays only in a group without any other. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, keep, kept_path, spread_join, text_or_empty

#: Digests of a bucket: its filter is built by one task.
BUCKET = 50_000
#: Hit buckets that a read of a segment names; with more of them it reads all rows.
HIT = 2_000
#: Copies of a text that are compared in one place.
SHARE = 1_000
#: Copies from which a digest's rows are joined where they lie.
SPREAD = 5_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class FuseFilter:
    """Binary fuse filter of 8-bit fingerprints over distinct 64-bit keys.

    Each key has one slot in each of three neighbouring segments. Keys that are alone in a slot are
    taken off layer by layer, whole layers at a time, and the slots are filled in the reverse order.
    """

    def __init__(self, seed: int, segment: int, slots: np.ndarray):
        self.seed, self.segment, self.slots = seed, segment, slots

    @staticmethod
    def _layout(n: int) -> tuple[int, int]:
        segment = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        return segment, max(3, math.ceil(n * factor / segment) + 2)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        starts = np.uint64(len(self.slots) // self.segment - 2)
        first = ((h >> np.uint64(32)) * starts >> np.uint64(32)).astype(np.int64)
        low = np.uint64(self.segment - 1)
        g = _mix(h)
        places = np.stack([first * self.segment + (g & low).astype(np.int64), (first + 1) * self.segment + ((g >> np.uint64(20)) & low).astype(np.int64), (first + 2) * self.segment + ((g >> np.uint64(40)) & low).astype(np.int64)])
        return places, (h & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys)
        segment, segments = cls._layout(len(keys))
        for seed in range(1, 200):
            made = cls(seed, segment, np.zeros(segment * segments, np.uint8))
            if made._fill(keys):
                return made
            if seed % 20 == 0:
                segments += max(1, segments // 10)
        raise RuntimeError("no seed peels all keys")

    def _fill(self, keys: np.ndarray) -> bool:
        places, prints = self._places(keys)
        size, n = len(self.slots), len(keys)
        number = np.arange(n, dtype=np.float64)
        counts = np.bincount(places.ravel(), minlength=size)
        sums = np.bincount(places.ravel(), weights=np.tile(number, 3), minlength=size)
        layers = []
        left = n
        while left:
            alone = np.flatnonzero(counts == 1)
            if not len(alone):
                return False
            who, at = np.unique(sums[alone].astype(np.int64), return_index=True)
            layers.append((who, alone[at]))
            gone = places[:, who].ravel()
            np.subtract.at(counts, gone, 1)
            np.subtract.at(sums, gone, np.tile(who.astype(np.float64), 3))
            left -= len(who)
        for who, slot in reversed(layers):
            a, b, c = places[:, who]
            self.slots[slot] = prints[who] ^ self.slots[a] ^ self.slots[b] ^ self.slots[c]
        return True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self._places(keys)
        return (self.slots[a] ^ self.slots[b] ^ self.slots[c]) == prints


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests.to_pylist()), np.uint64)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def build_filters(distinct: DataFrame) -> DataFrame:
    """bucket, seed, segment, slots for the digests of each bucket."""

    def build(group: pa.Table) -> pa.Table:
        made = FuseFilter.build(_keys(group.column("digest")))
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "seed": pa.array([made.seed], pa.int32()), "segment": pa.array([made.segment], pa.int32()), "slots": pa.array([made.slots.tobytes()], pa.binary())})

    return distinct.select("digest", "bucket").groupBy("bucket").applyInArrow(build, "bucket int, seed int, segment int, slots binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """incoming's distinct digests (digest, copies, last) with bucket and positive: whether the segment may hold them."""

    def test(group: pa.Table, own: pa.Table) -> pa.Table:
        hit = np.zeros(group.num_rows, bool)
        if group.num_rows and own.num_rows:
            row = own.to_pylist()[0]
            hit = FuseFilter(row["seed"], row["segment"], np.frombuffer(row["slots"], np.uint8)).holds(_keys(group.column("digest")))
        return group.append_column("positive", pa.array(hit))

    dealt = incoming.select("digest", "copies", "last", _bucket(buckets).alias("bucket")).groupBy("bucket")
    return dealt.cogroup(filters.groupBy("bucket")).applyInArrow(test, "digest binary, copies long, last long, bucket int, positive boolean")


ROWS = "digest binary, copies long, last long, bucket int"
REPEATS = "digest binary, more long, other long, copies long, last long"


@dataclass
class Segments:
    """The segments of a folder, one for each batch, numbered from 0: rows, filters and repeats. A segment's bucket
    count stands in its name, so that a later application finds all it needs (Segments.open)."""

    spark: SparkSession
    path: str
    buckets: list[int] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Segments:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        found = sorted((int(n.split("-")[1]), int(n.split("-")[2])) for n in names if n.startswith("segment-"))
        return cls(spark, path, [b for _, b in found])

    def _part(self, k: int, kind: str) -> str:
        return f"{self.path}/segment-{k}-{self.buckets[k]}/{kind}"

    def rows(self, k: int) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(self._part(k, "rows"))

    def filters(self, k: int) -> DataFrame:
        return self.spark.read.schema("bucket int, seed int, segment int, slots binary").parquet(self._part(k, "filters"))

    def repeats(self, k: int) -> DataFrame:
        return self.spark.read.schema(REPEATS).parquet(self._part(k, "repeats"))

    def add(self, batch: DataFrame) -> None:
        """Screen batch (digest, copies, last; each digest once) and store its segment. Nothing older is written."""
        left, repeats = batch.select("digest", "copies", "last"), None
        for k in range(len(self.buckets)):
            screened = keep(screen(left, self.filters(k), self.buckets[k]), "screened")
            positives = screened.where("positive").drop("positive")
            hit = [r["bucket"] for r in positives.select("bucket").distinct().limit(HIT + 1).collect()]
            held = self.rows(k).where(F.col("bucket").isin(hit)) if len(hit) <= HIT else self.rows(k)
            asked = positives.select("digest", "bucket", F.col("copies").alias("more"), F.col("last").alias("other"))
            found = keep(asked.join(held, ["digest", "bucket"]).select("digest", "more", "other", "copies", "last"), "confirmed")
            false = positives.join(found.select("digest"), "digest", "left_anti")
            left = screened.where("not positive").select("digest", "copies", "last").unionByName(false.select("digest", "copies", "last"))
            repeats = found if repeats is None else repeats.unionByName(found)
        k = len(self.buckets)
        left = keep(left, "new")
        self.buckets.append(max(1, math.ceil(left.count() / BUCKET)))
        left.withColumn("bucket", _bucket(self.buckets[k])).repartition("bucket").sortWithinPartitions("bucket").write.parquet(self._part(k, "rows"))
        build_filters(self.rows(k)).write.parquet(self._part(k, "filters"))
        (repeats if repeats is not None else self.spark.createDataFrame([], REPEATS)).write.parquet(self._part(k, "repeats"))

    def several(self) -> DataFrame:
        """digest, copies, last of all digests with two copies or more, over all segments."""
        again, alone = self.repeats(0), self.rows(0).where("copies > 1").select("digest", "copies", "last")
        for k in range(1, len(self.buckets)):
            again = again.unionByName(self.repeats(k))
            alone = alone.unionByName(self.rows(k).where("copies > 1").select("digest", "copies", "last"))
        more = again.groupBy("digest").agg((F.sum("more") + F.first("copies")).alias("copies"), F.greatest(F.max("other"), F.max("last")).alias("last"))
        return keep(more.unionByName(alone.join(more.select("digest"), "digest", "left_anti")), "several")


def exact_dedup(docs: DataFrame, batches: int = 2, digest: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs.

    docs come in as so many batches (by a hash of doc_id): each leaves a segment and is screened by those before it.
    digest: another binary digest of `text`, for tests of the byte check.
    """
    text = text_or_empty()
    source = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    chosen = digest if digest is not None else F.unhex(F.sha2(F.col("text"), 256))
    rows = keep(source.select("doc_id", chosen.alias("digest"), F.sha2("text", 256).alias("text_sha256"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")), "digests")
    grouped = keep(rows.groupBy("batch", "digest").agg(F.count("*").alias("copies"), F.max("doc_id").alias("last")), "groups")
    segments = Segments(docs.sparkSession, kept_path(docs.sparkSession, f"segments-{uuid.uuid4().hex}"))
    for k in range(batches):
        segments.add(grouped.where(F.col("batch") == k).drop("batch"))

    # each thousand copies of a text meet a copy of the text that stays, so that large groups spread
    several = segments.several().withColumn("shares", F.ceil(F.col("copies") / SHARE).cast("int"))
    known = rows.where("doc_id is not null").select("doc_id", "digest").distinct()
    members = keep(spread_join(known, several.select("digest", "copies", "last", "shares"), "digest", "copies", hot=SPREAD).drop("copies").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int")), "members")
    n_members = members.count()
    texts = source.join(broadcast_if_small(members, n_members, 500_000), "doc_id").where((chosen if digest is not None else F.unhex(F.sha2(F.col("text"), 256))) == F.col("digest"))
    stays = texts.where("doc_id = last").groupBy("digest", "shares").agg(F.min("text").alias("stays"))
    stays = stays.select("digest", "stays", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("part"))
    differ = texts.join(stays, ["digest", "part"]).where("text <> stays").select("digest", "doc_id", F.sha2("text", 256).alias("text_sha256"), "text")
    apart = keep(differ.groupBy("digest", "text", "text_sha256").agg(F.max("doc_id").alias("own_last"), F.count("*").alias("own_copies")).drop("text"), "apart")
    gone = apart.groupBy("digest").agg(F.sum("own_copies").alias("gone"))

    result = spread_join(rows, several.select("digest", "copies", "last"), "digest", "copies", "left", SPREAD)
    if apart.limit(1).count():
        result = result.join(gone, "digest", "left").join(apart, ["digest", "text_sha256"], "left")
        size = F.coalesce("own_copies", F.col("copies") - F.coalesce("gone", F.lit(0)), F.lit(1))
        last = F.coalesce("own_last", "last", "doc_id")
    else:
        size, last = F.coalesce("copies", F.lit(1)), F.coalesce("last", "doc_id")
    return result.select("doc_id", last.alias("keep_id"), size.cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(last).alias("kept"), "text_sha256")


EXACT_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
