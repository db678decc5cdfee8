"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(scale * x). Queries and candidates are dealt into blocks, and every
query block meets every candidate block in a task of bounded size. Each pass scores all pairs and makes
a histogram of each query's current score range; a block need not report buckets below the one that
holds its own kth score. The sums show which bucket holds the query's kth score, and that bucket is the
range of the next pass, until it is one score wide. The last pass keeps scores above the kth value, and
of those equal to it the smallest ids, as many as are still needed.

A vector that is null or holds a null or non-finite component takes no part, nor does a null id. Of
rows that share an id one counts, the one with the smallest vector in array order. A shorter vector
counts as if it ended in zeros. Components beyond the 64-bit range are cut to it, and so are scores. A
query without candidates has no rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Queries and candidates that meet in a task. A candidate is dealt once for each query block, so query blocks are large.
QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 8_192
#: Pairs are scored in tiles of so many queries by so many candidates: 16 MB.
TILE = (1_024, 2_048)
BUCKETS = 256
TOP = (1 << 62) - 1
_NONE = -(1 << 63)


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v (array<bigint>), one row for each id."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return rows.select(F.col("vec_id").cast("long"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    sizes = np.diff(np.asarray(rows.offsets))
    flat = np.asarray(rows.flatten())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    return out


class Tiles:
    """Inner products of a query block with a candidate block as int64, a tile at a time; a query's own id scores _NONE.
    Exact in doubles while sums stay under 2^53."""

    def __init__(self, queries: pa.Table, candidates: pa.Table):
        width = max([1, *(int(pc.max(pc.list_value_length(t.column("v"))).as_py() or 0) for t in (queries, candidates))])
        self.q, self.c = _matrix(queries.column("v"), width), _matrix(candidates.column("v"), width)
        self.own, self.ids = np.asarray(queries.column("vec_id")), np.asarray(candidates.column("vec_id"))
        self.bound = float(np.abs(self.q.astype(float)).max(initial=0)) * float(np.abs(self.c.astype(float)).max(initial=0)) * width
        self.kind = float if self.bound < 1 << 53 else np.int64 if self.bound < 1 << 62 else object
        self.q, self.c = self.q.astype(self.kind, copy=False), self.c.astype(self.kind, copy=False)

    def rows(self) -> Iterator[tuple[slice, Iterator[tuple[slice, np.ndarray]]]]:
        """For each slice of queries: the slices of candidates with their scores."""
        for a in range(0, len(self.own), TILE[0]):
            part = slice(a, min(a + TILE[0], len(self.own)))
            yield part, self._across(part)

    def _across(self, part: slice) -> Iterator[tuple[slice, np.ndarray]]:
        for b in range(0, len(self.ids), TILE[1]):
            other = slice(b, min(b + TILE[1], len(self.ids)))
            out = self.q[part] @ self.c[other].T
            out = (np.clip(out, -TOP, TOP) if self.kind is object else out).astype(np.int64)
            ids = self.ids[other]
            order = np.argsort(ids)
            at = np.minimum(np.searchsorted(ids[order], self.own[part]), len(ids) - 1)
            here = np.flatnonzero(ids[order][at] == self.own[part])
            out[here, order[at[here]]] = _NONE
            yield other, out


def scores(queries: pa.Table, candidates: pa.Table) -> np.ndarray:
    """All scores of two blocks."""
    return np.concatenate([np.concatenate([s for _, s in across], axis=1) for _, across in Tiles(queries, candidates).rows()])


def _histogram(candidates: pa.Table, queries: pa.Table) -> pa.Table:
    """query_id, bucket, n of a block's scores, from the top down to the block's own kth score."""
    found = []
    if queries.num_rows and candidates.num_rows:
        low, width, span, need = (np.asarray(queries.column(c)) for c in ("low", "width", "span", "need"))
        for part, across in Tiles(queries, candidates).rows():
            n = part.stop - part.start
            counts = np.zeros(n * BUCKETS, np.int64)
            line = np.arange(n)[:, None] * BUCKETS
            for _, s in across:
                inside = (s != _NONE) & (s >= low[part, None]) & (s < (low + span)[part, None])
                s -= low[part, None]
                s //= width[part, None]
                s += line
                counts += np.bincount(s[inside], minlength=n * BUCKETS)
            counts = counts.reshape(-1, BUCKETS)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            r, b = np.nonzero((counts > 0) & (above < need[part, None]))
            found.append((r + part.start, b, counts[r, b]))
    r, b, n = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
    ids = queries.column("vec_id").take(pa.array(r, pa.int64())) if found else pa.array([], pa.int64())
    return pa.table({"query_id": ids, "bucket": pa.array(b, pa.int32()), "n": pa.array(n, pa.int64())})


def _survivors(candidates: pa.Table, queries: pa.Table) -> pa.Table:
    """query_id, vec_id, score over the kth score, and of those equal to it the smallest ids, as many as are needed."""
    query, vec, score = [], [], []
    if queries.num_rows and candidates.num_rows:
        low, need = np.asarray(queries.column("low")), np.asarray(queries.column("need"))
        tiles = Tiles(queries, candidates)
        for part, across in tiles.rows():
            own_low, own_need = low[part], need[part]
            equal: list[list[np.ndarray]] = [[] for _ in own_low]
            for other, s in across:
                ids = tiles.ids[other]
                r, c = np.nonzero((s > own_low[:, None]) & (s != _NONE))
                query.append(tiles.own[part][r])
                vec.append(ids[c])
                score.append(s[r, c])
                r, c = np.nonzero((s == own_low[:, None]) & (s != _NONE))
                cuts = np.flatnonzero(np.diff(r)) + 1
                for i, j in zip(r[np.r_[0, cuts]] if len(r) else (), np.split(c, cuts), strict=bool(len(r))):
                    equal[i].append(np.sort(ids[j])[: own_need[i]])
            for i, some in enumerate(equal):
                if some:
                    ties = np.sort(np.concatenate(some))[: own_need[i]]
                    query.append(np.full(len(ties), tiles.own[part][i]))
                    vec.append(ties)
                    score.append(np.full(len(ties), own_low[i]))
    joined = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (query, vec, score)]
    return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), joined, strict=True)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row that is_query picks."""
    rows = keep(integer_vectors(vectors, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, widest = rows.agg(F.count("*"), F.max(square)).first()
    queries = rows.where(is_query)
    query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    candidate_blocks = max(1, math.ceil((n or 1) / CANDIDATE_BLOCK))
    # no score is larger than the largest squared length
    bound = min(int((widest or 0) * (1 + 1e-9)) + 1, TOP)
    width = -(-(2 * bound + 1) // BUCKETS)

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    candidates = dealt(rows, "cb", candidate_blocks, "qb", query_blocks).groupBy("qb", "cb")
    state = queries.select("vec_id", "v", F.lit(-bound).cast("long").alias("low"), F.lit(width).cast("long").alias("width"), F.lit(2 * bound + 1).cast("long").alias("span"), F.lit(k).cast("long").alias("need"))

    def met(work, schema: str) -> DataFrame:
        return candidates.cogroup(dealt(state, "qb", query_blocks, "cb", candidate_blocks).groupBy("qb", "cb")).applyInArrow(work, schema)

    done = False
    while not done:
        done = width == 1
        found = met(_histogram, "query_id long, bucket int, n long").groupBy("query_id", "bucket").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("bucket").desc()))
        ranked = found.withColumn("reached", above).join(state.select(F.col("vec_id").alias("query_id"), "need"), "query_id").where("reached >= need")
        kth = ranked.groupBy("query_id").agg(F.max(F.struct("bucket", "n", "reached", "need")).alias("b")).select("query_id", "b.*")
        # where fewer candidates than k are left, the bottom of the range is the cut
        state = state.drop("need").join(kth.select(F.col("query_id").alias("vec_id"), "bucket", (F.col("need") - F.col("reached") + F.col("n")).alias("need")), "vec_id", "left")
        narrower = -(-width // BUCKETS) if width > 1 else 1
        state = keep(state.select("vec_id", "v", (F.col("low") + F.coalesce("bucket", F.lit(0)) * F.col("width")).alias("low"), F.lit(narrower).cast("long").alias("width"), F.lit(width).cast("long").alias("span"), F.coalesce("need", F.lit(k)).alias("need")), "range")
        width = narrower
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    final = met(_survivors, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(best))
    return final.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
        from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
  r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 20
"""
