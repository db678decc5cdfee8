"""Near-duplicate documents by bottom-k sketches of word shingles.

1. One pass over the texts hashes every word shingle with one hash function. A document's sketch is its
   k smallest hashes. Documents with one and the same set form a class, which its smallest id stands for.
2. Inverted lists of retained values generate overlaps. If two sketches share at least a values, the
   k - a + 1 rarest values of each (in any common order) have one in common, so only those are listed:
   frequent passages stay out. Rarity comes from a hashed count table of fixed size. Each list names its
   smallest document, the pivot, and documents are gathered by pivot, so that a list of N documents
   gives N rows, never N^2.
3. Within a pivot's group (cut by set size) union-sketch estimates drop documents that have no likely partner.
4. The rest are read again; the exact Jaccard similarity of their full sets of shingle hashes decides.
   A group returns a spanning forest of its links, which keeps components whole.
5. A group of over CHUNK_DOCS documents first meets a few leaders, chosen by a hash, chunk by chunk: N
   documents give N rows. Those that a leader's links join are in one component already, so they need
   not meet each other. What is left meets across the parts so found: chunks of one part never meet, and
   a group of edited copies is done with its leaders. Chunks of different parts meet pair by pair.

The shortest overlap a lies 0.25 below the threshold: a true link of threshold similarity falls short of
it with a probability of about 1e-7 at k = 64. Hashes have 64 bits.

Words are runs of [^\\x20\\x09-\\x0D] after A-Z is lowered. With fewer words than a shingle has, the whole
sequence is the only one. Null or empty texts have no shingles and link with nothing. Equal rows are
one node; rows that share a doc_id but not a text are one node with several sets, and a link of any of
them counts. Rows with a null doc_id link with nothing: component_id is null and kept is true. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, arrow_map, broadcast_if_small, by_group, fold_pages, keep, spread_join, text_or_empty
from .components import components

#: Cells of the hashed count table: 4 MB whatever the input. Only an order is taken from it, and any order is right.
CELLS = 1 << 20
PAGE = 1 << 16
#: Documents, and shingles in all, of a chunk at most; a group's task holds two chunks.
CHUNK_DOCS = 512
CHUNK_SHINGLES = 1_500_000
#: Documents that all others of a large group meet first.
LEADERS = 4
#: How far below the threshold the shared part of two sketches may fall.
SLACK = 0.25
DEVIATIONS = 5.5

_rng = np.random.RandomState(20240607)
_BYTE = _rng.randint(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE.encode())] = True


class Shingler:
    """Distinct 64-bit shingle hashes of a text, sorted. All work is on whole arrays of bytes and words."""

    def __init__(self, width: int):
        self.width = width
        self.power = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        while len(self.power) < n:
            size = len(self.power)
            self.power = np.concatenate([self.power, self.power * np.uint64(pow(_BASE, size, 1 << 64))])
            self.inverse = np.concatenate([self.inverse, self.inverse * np.uint64(pow(_INVERSE, size, 1 << 64))])

    def words(self, text: bytes) -> np.ndarray:
        """A hash of each word: sum of table[byte] * base^position, read off one running sum."""
        raw = np.frombuffer(text, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~_SPACE[raw]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.empty(0, np.uint64)
        self._reach(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.power[: len(raw)], out=total[1:])
        return (total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64)

    def shingles(self, text: bytes) -> np.ndarray:
        words = self.words(text)
        if not len(words):
            return words
        width = min(self.width, len(words))
        n = len(words) - width + 1
        acc = _mix(words[:n] + np.uint64(width * 0x51ED27))
        for j in range(1, width):
            acc = _mix(acc + words[j : j + n])
        return np.unique(acc)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_table(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, sketch (k smallest hashes, 8 bytes each)."""

    def work():
        shingler = Shingler(width)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, digest, sketch = [], [], []
            for text in batch.column(1):
                found = shingler.shingles(text.as_buffer().to_pybytes())
                n.append(len(found))
                digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketch.append(found[:k].tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "digest", "sketch"])

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), "doc_id long, n_shingles long, digest binary, sketch binary", work)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def work():
        shingler = Shingler(width)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingler.shingles(t.as_buffer().to_pybytes()).tobytes() for t in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])

        return step

    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), "doc_id long, hashes binary", work)


def _values(column: pa.Array) -> np.ndarray:
    """All 64-bit values of a binary column, row after row."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint64)


def value_counts(sketches: DataFrame) -> np.ndarray:
    """How often each cell's values are retained: pages are summed by the executors, 4 MB come back."""

    def count(batches):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            cells += np.bincount((_values(batch.column(0)) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        pages = [(i, zlib.compress(np.minimum(p, 1 << 31).astype(np.uint32).tobytes(), 1)) for i, p in enumerate(cells.reshape(-1, PAGE)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pages], pa.int32()), pa.array([p for _, p in pages], pa.binary())], names=["page", "counts"])

    def add(total: np.ndarray, row: dict) -> np.ndarray:
        return total + np.frombuffer(zlib.decompress(row["counts"]), np.uint32)

    schema = "page int, counts binary"
    pages = fold_pages(sketches.select("sketch").mapInArrow(count, schema), "page", schema, lambda: np.zeros(PAGE, np.uint64), add, lambda total: zlib.compress(np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes(), 1))
    cells = np.zeros(CELLS, np.uint32)
    for row in pages.collect():
        cells[row["page"] * PAGE : (row["page"] + 1) * PAGE] = np.frombuffer(zlib.decompress(bytes(row["counts"])), np.uint32)
    return cells


def listed_values(sketches: DataFrame, counts: np.ndarray, share: float) -> DataFrame:
    """value, doc_id, n_shingles for the rarest values of each sketch that must hold a shared one."""
    sent = sketches.sparkSession.sparkContext.broadcast(counts)

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cells = sent.value
            values, rows = [], []
            for i, sketch in enumerate(batch.column(2).to_pylist()):
                own = np.frombuffer(sketch, np.uint64)
                least = max(1, int(np.ceil(share * len(own) - 1e-9)))
                order = np.lexsort((own, cells[own & np.uint64(CELLS - 1)]))[: len(own) - least + 1]
                values.append(own[order])
                rows.append(np.full(len(order), i))
            at = np.concatenate(rows) if rows else np.empty(0, np.int64)
            found = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64()))], names=["value", "doc_id", "n_shingles"])

        return step

    return arrow_map(sketches.select("doc_id", "n_shingles", "sketch"), "value long, doc_id long, n_shingles long", work)


GROUP = ["pivot", "g"]
KEYS = [*GROUP, "low", "high"]
MEMBER = [*GROUP, "doc_id", "n_shingles", "band"]


def _hashed(pieces: Column | str) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.col(pieces) if isinstance(pieces, str) else pieces).cast("int")


def _group_sizes(members: DataFrame) -> DataFrame:
    sizes = members.groupBy(*GROUP).agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles")).where("docs > 1")
    chunks = F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    return keep(sizes.select(*GROUP, chunks.alias("chunks")), "sizes")


def _with_leaders(large: DataFrame) -> DataFrame:
    """large(MEMBER, chunks): every chunk of a group (side 1) with the group's leaders (side 0)."""
    order = Window.partitionBy(*GROUP).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    leaders = large.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= LEADERS).drop("_n")
    first = leaders.select(*MEMBER, F.lit(-1).alias("low"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("high"), F.lit(0).alias("side"))
    return first.unionByName(large.select(*MEMBER, F.lit(-1).alias("low"), _hashed("chunks").alias("high"), F.lit(1).alias("side")))


def _across_parts(large: DataFrame, found: DataFrame) -> DataFrame:
    """Members of large groups dealt into chunks that meet pair by pair: adds low, high and side (0: low's, 1: high's).

    found(node, component): what is linked so far. Chunks that hold one component only don't meet each other.
    """
    n_found = found.count()
    part = large.join(broadcast_if_small(found.select(F.col("node").alias("doc_id"), F.col("component").alias("part")), n_found, 500_000), "doc_id", "left")
    part = keep(part.withColumn("part", F.coalesce("part", "doc_id")), "parts")
    counts = part.groupBy(*GROUP, "part").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    pieces = F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    wide = keep(counts.where(F.col("docs") * 4 >= CHUNK_DOCS).select(*GROUP, "part", pieces.alias("pieces")), "wide")
    n_wide = wide.count()
    # small parts share chunks; their part is null from here on
    named = part.join(broadcast_if_small(wide.select(*GROUP, "part", F.lit(True).alias("own")), n_wide), [*GROUP, "part"], "left").withColumn("part", F.when(F.col("own"), F.col("part"))).drop("own")
    rest = named.where("part is null").groupBy(*GROUP).agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles")).select(*GROUP, F.lit(None).cast("long").alias("part"), pieces.alias("pieces"))
    chunks = wide.unionByName(rest).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    number = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("part").asc_nulls_first(), "piece")) - 1
    chunks = keep(chunks.withColumn("own", number), "chunks")
    n_chunks = chunks.count()
    other = chunks.select(*GROUP, F.col("part").alias("other_part"), F.col("own").alias("other"))
    meets = chunks.join(other, GROUP).where("own <= other and (part is null or other_part is null or part <> other_part)")
    low = meets.select(*GROUP, "part", "piece", "pieces", F.col("own").alias("low"), F.col("other").alias("high"), F.lit(0).alias("side"))
    back = chunks.withColumnRenamed("own", "other").join(meets.where("own < other").select(*GROUP, "own", "other"), [*GROUP, "other"])
    high = back.select(*GROUP, "part", "piece", "pieces", F.col("own").alias("low"), F.col("other").alias("high"), F.lit(1).alias("side"))
    seats = keep(low.unionByName(high), "seats")
    pieces_of = chunks.select(*GROUP, F.col("part").alias("_part"), "pieces").distinct()
    placed = named.join(broadcast_if_small(pieces_of, n_chunks), [named[c] == pieces_of[c] for c in GROUP] + [named["part"].eqNullSafe(pieces_of["_part"])]).select(*(named[c] for c in [*MEMBER, "part"]), _hashed("pieces").alias("_piece"))
    seats = seats.select(*(F.col(c).alias(f"_{c}") for c in GROUP), F.col("part").alias("_part"), F.col("piece").alias("_own_piece"), "low", "high", "side")
    n_seats = seats.count()
    match = (F.col("pivot") == F.col("_pivot")) & (F.col("g") == F.col("_g")) & F.col("part").eqNullSafe(F.col("_part")) & (F.col("_piece") == F.col("_own_piece"))
    return placed.join(broadcast_if_small(seats, n_seats, 500_000), match).select(*MEMBER, "low", "high", "side")


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two sides that meet; equal chunks meet themselves."""
    same = group.column("low")[0].as_py() == group.column("high")[0].as_py()
    side = np.asarray(group.column("side"))
    return (np.arange(len(side)), np.arange(len(side)), True) if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1), False)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of two lists of sets (right None: left with itself), by blocks of a 0/1 matrix product."""
    sets = left + (right or [])
    sizes = [len(s) for s in sets]
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    number = np.cumsum(new) - 1
    often = np.bincount(number) > 1
    column = (np.cumsum(often) - 1)[number]
    use = often[number]
    column, row = column[use], row[use]
    n, width = len(left), int(often.sum())
    out = np.zeros((n, len(right) if right is not None else n), np.float32)
    step = max(64, 4_000_000 // max(1, len(sets)))
    for at in range(0, width, step):
        a, b = np.searchsorted(column, [at, at + step])
        block = np.zeros((len(sets), min(step, width - at)), np.float32)
        block[row[a:b], column[a:b] - at] = 1
        out += block[:n] @ (block if right is None else block[n:]).T
    return out.astype(np.int64)


def likely(group: pa.Table, percent: int) -> pa.Table:
    """Rows that have a partner whose union-sketch estimate is near the threshold or above it."""
    left, right, same = _sides(group)
    if not len(left) or not len(right):
        return group.slice(0, 0).drop(["sketch"])
    sketches = [np.frombuffer(s, np.uint64) for s in group.column("sketch").to_pylist()]
    n = np.asarray(group.column("n_shingles"))
    band, g = np.asarray(group.column("band")), group.column("g")[0].as_py()
    a, b = [sketches[i] for i in left], [sketches[i] for i in right]
    shared = shared_counts(a, None if same else b)
    t = percent / 100
    longest = max(len(s) for s in sketches)
    padded = np.full((len(right), longest), np.iinfo(np.uint64).max, np.uint64)
    for i, s in enumerate(b):
        padded[i, : len(s)] = s
    top_b = np.array([s[-1] if len(s) < n[r] else np.iinfo(np.uint64).max for s, r in zip(b, right, strict=True)])
    size_b = np.array([len(s) for s in b])
    hit_a, hit_b = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for i, s in enumerate(a):
        # only partners that could pass: enough shared values, sizes in reach, and the band rule
        can = (shared[i] > 0) & (np.minimum(n[left[i]], n[right]) >= t * np.maximum(n[left[i]], n[right]) - 1e-9) & ((band[left[i]] == g) | (band[right] == g))
        if same:
            can[i] = False
        at = np.flatnonzero(can)
        if not len(at):
            continue
        top_a = s[-1] if len(s) < n[left[i]] else np.iinfo(np.uint64).max
        limit = np.minimum(top_a, top_b[at])
        below_a = np.searchsorted(s, limit, side="right")
        below_b = np.where(top_b[at] <= top_a, size_b[at], (padded[at] <= top_a).sum(1) if top_a != np.iinfo(np.uint64).max else size_b[at])
        union = below_a + below_b - shared[i][at]
        whole = limit == np.iinfo(np.uint64).max
        least = np.where(whole, t - 1e-9, t - DEVIATIONS * np.sqrt(t * (1 - t) / union))
        passed = at[shared[i][at] >= least * union]
        if len(passed):
            hit_a[i] = True
            hit_b[passed] = True
    rows = np.unique(np.concatenate([left[hit_a], right[hit_b]]))
    return group.drop(["sketch"]).take(pa.array(rows, pa.int64()))


def confirmed(group: pa.Table, percent: int) -> pa.Table:
    """A spanning forest (a, b) of the links whose exact similarity reaches the threshold."""
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    left, right, same = _sides(group)
    if not len(left) or not len(right):
        return empty
    sets = [np.frombuffer(s, np.uint64) for s in group.column("hashes").to_pylist()]
    ids = np.asarray(group.column("doc_id"))
    n = np.array([len(s) for s in sets])
    shared = shared_counts([sets[i] for i in left], None if same else [sets[i] for i in right])
    union = n[left][:, None] + n[right][None, :] - shared
    x, y = np.nonzero((100 * shared >= percent * union) & (shared > 0))
    parent = {d: d for d in {*ids.tolist()}}

    def find(d: int) -> int:
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    for p, q in zip(ids[left[x]].tolist(), ids[right[y]].tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            parent[max(p, q)] = min(p, q)
    out = [(find(d), d) for d in parent if find(d) != d]
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([d for _, d in out], pa.int64())}) if out else empty


def _confirmed_links(docs: DataFrame, stands: DataFrame, dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: a spanning forest of the exact links within dealt(MEMBER, low, high, side)'s groups of KEYS."""
    grouped = keep(dealt, "dealt")
    columns = "pivot long, g int, doc_id long, n_shingles long, band int, low int, high int, side int"
    names = [c.split()[0] for c in columns.split(", ")]
    with_sketch = stands.select("doc_id", "sketch").join(broadcast_if_small(grouped, grouped.count(), 500_000), "doc_id")
    near = keep(by_group(with_sketch.select(*names, "sketch"), KEYS, ["side"], columns, lambda group: likely(group, percent).select(names)), "likely")
    wanted = keep(near.select("doc_id").distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(broadcast_if_small(wanted, wanted.count()), "doc_id", "left_semi")
    pairs = full_sets(texts, width).join(broadcast_if_small(near, near.count(), 500_000), "doc_id")
    return by_group(pairs.select("doc_id", "hashes", *KEYS, "side"), KEYS, ["side"], "a long, b long", lambda group: confirmed(group, percent))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    t = percent / 100
    table = keep(sketch_table(docs, width, k), "sketches")
    classes = keep(table.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    n_classes = classes.count()
    chosen = classes.select("digest", F.col("rep").alias("doc_id"))
    stands = table.join(broadcast_if_small(chosen, n_classes, 500_000), ["digest", "doc_id"], "left_semi")

    listed = listed_values(stands, value_counts(stands), max(0.05, t - SLACK))
    pivots = listed.groupBy("value").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("pivot < last").select("value", "pivot", "n")
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(max(-np.log(t), 1e-6)) * 1.0001)).cast("int")
    members = spread_join(listed, pivots, "value", "n").select("pivot", "doc_id", "n_shingles").distinct().withColumn("band", band)
    members = keep(members.withColumn("g", F.explode(F.array(F.col("band"), F.col("band") - 1))).select(*MEMBER), "members")
    sizes = _group_sizes(members)
    large_groups = sizes.where("chunks > 1")
    n_large = large_groups.count()
    few = broadcast_if_small(large_groups, n_large)
    others = members.join(few.select(*GROUP), GROUP, "left_anti") if n_large else members
    small = others.join(sizes.where("chunks = 1").select(*GROUP), GROUP, "left_semi").select(*MEMBER, F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side"))
    if n_large:
        large = keep(members.join(few, GROUP), "large")
        links = keep(_confirmed_links(docs, stands, small.unionByName(_with_leaders(large)), width, percent), "links")
        dealt = keep(_across_parts(large, components(links)), "dealt")
        if dealt.limit(1).count():
            links = links.unionByName(_confirmed_links(docs, stands, dealt, width, percent))
    else:
        links = _confirmed_links(docs, stands, small, width, percent)
    # rows that share an id but not a set
    known = table.where("n_shingles > 0 and doc_id is not null").select("doc_id", "digest")
    several = keep(known.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x < y").select("doc_id"), "several")
    shared_ids = known.join(broadcast_if_small(several, several.count()), "doc_id", "left_semi").distinct().join(classes, "digest").select("doc_id", "rep")
    twice = shared_ids.groupBy("doc_id").agg(F.min("rep").alias("a")).join(shared_ids, "doc_id").select("a", F.col("rep").alias("b"))
    found = keep(components(links.unionByName(twice)), "components")

    # a class brings its component along; rows of no class look theirs up by id
    shared = classes.where("copies > 1").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("of_class"), "copies")
    result = spread_join(table.select("doc_id", "n_shingles", "digest"), shared, "digest", "copies", "left")
    result = result.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    result = result.withColumn("component_id", F.when(linked, F.coalesce("of_class", "component", "doc_id")).otherwise(F.col("doc_id")))
    return result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
