"""Line dedup with two Bloom filters, for hashes seen once and hashes seen twice.

1. Each task hashes the keys of its documents' lines into a pair of filters: a hash that the first
   already holds enters the second. Pairs merge page by page: (o1, t1) + (o2, t2) =
   (o1 | o2, t1 | t2 | o1 & o2), which keeps every hash that two documents share.
2. The second filter goes to all tasks. Keys that it lacks occur in one document only; the others are
   suspected repeats, and they alone shuffle.
3. Suspects are grouped by the key itself, which confirms repeats exactly and finds the smallest
   doc_id. Every other document that holds the key gets it on its list of lines to drop.

Filters have 12 to 24 bits a line. Up to MAX_BITS (64 MB) the second one is broadcast. Where lines need
more, hashes are dealt into shards, each with a pair of filters of its own size, built and asked where the
shard lies: hashes and 16-byte digests travel there, never lines, and filters grow with the input. Keys
are then told apart by their 128-bit digests. A shard that a frequent line makes large is asked in parts.

A key is a line without [\\x20\\x09-\\x0D] at both ends, with A-Z lowered. Keys under min_chars code
points are never dropped. Null and empty texts are one empty line. Rows that share a doc_id count as
one document. Rows with a null doc_id keep all their lines and count for nobody. An empty table gives
an empty result; extra columns are ignored or passed through.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, arrow_map, broadcast_if_small, fold_pages, keep, spread_join, text_or_empty

MAX_BITS = 1 << 29
BITS_A_LINE = 12
#: 64-bit words of a page.
PAGE = 1 << 16
#: Lists of lines to drop that may be broadcast; larger ones join by a shuffle.
BROADCAST_BYTES = 24 << 20

_BLANK = SPACE.encode()


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(_BLANK).lower() for line in text.split(b"\n")]


def long_keys(text: bytes, min_chars: int) -> set[bytes]:
    sure = 4 * min_chars  # a code point has 4 bytes at most
    return {k for k in line_keys(text) if len(k) >= min_chars and (len(k) >= sure or len(k.decode()) >= min_chars)}


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class FilterPair:
    """Blocked Bloom filters: a hash sets 4 bits of one 64-bit word."""

    def __init__(self, words: int):
        self.shift = np.uint64(64 - words.bit_length() + 1)
        self.once = np.zeros(words, np.uint64)
        self.twice = np.zeros(words, np.uint64)

    @staticmethod
    def masks(hashes: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        return (one << (hashes & low)) | (one << ((hashes >> np.uint64(6)) & low)) | (one << ((hashes >> np.uint64(12)) & low)) | (one << ((hashes >> np.uint64(18)) & low))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    @staticmethod
    def put(into: np.ndarray, at: np.ndarray, masks: np.ndarray) -> None:
        if len(at):
            order = np.argsort(at, kind="stable")
            at, masks = at[order], masks[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            into[at[first]] |= np.bitwise_or.reduceat(masks, first)

    def add(self, hashes: np.ndarray) -> None:
        """hashes: each document's distinct ones, so that one that comes again comes from another document."""
        found, n = np.unique(hashes, return_counts=True)
        at, masks = self.places(found), self.masks(found)
        again = (n > 1) | ((self.once[at] & masks) == masks)
        self.put(self.twice, at[again], masks[again])
        self.put(self.once, at, masks)


def _sparse(words: np.ndarray) -> bytes:
    at = np.flatnonzero(words)
    return zlib.compress(at.astype(np.uint16).tobytes() + words[at].tobytes(), 1)


def _spread(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    n = len(raw) // 10
    out = np.zeros(PAGE, np.uint64)
    out[np.frombuffer(raw[: 2 * n], np.uint16)] = np.frombuffer(raw[2 * n :], np.uint64)
    return out


def _batch_hashes(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Hashes of each document's distinct long keys, the keys, and how many each document has."""
    keys: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = long_keys(text.as_buffer().to_pybytes(), min_chars)
        counts[i] = len(own)
        keys += own
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), keys, counts


def twice_seen(rows: DataFrame, lines: int, min_chars: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """The merged filter of hashes that two documents hold."""
    bits = 1 << max(22, min(max_bits, BITS_A_LINE * max(lines, 1)).bit_length())
    words = max(PAGE, min(bits, max_bits) // 64)

    def build(batches):
        pair = FilterPair(words)
        for batch in batches:
            pair.add(_batch_hashes(batch.column(1), min_chars)[0])
        for page in range(0, words, PAGE):
            once, twice = pair.once[page : page + PAGE], pair.twice[page : page + PAGE]
            if once.any():
                yield pa.RecordBatch.from_arrays([pa.array([page // PAGE], pa.int32()), pa.array([_sparse(once)], pa.binary()), pa.array([_sparse(twice)], pa.binary())], names=["page", "once", "twice"])

    def add(held: list[np.ndarray], row: dict) -> list[np.ndarray]:
        once, twice = _spread(row["once"]), _spread(row["twice"])
        held[1] |= twice | (held[0] & once)
        held[0] |= once
        return held

    pages = rows.mapInArrow(build, "page int, once binary, twice binary")
    merged = fold_pages(pages, "page", "page int, twice binary", lambda: [np.zeros(PAGE, np.uint64), np.zeros(PAGE, np.uint64)], add, lambda held: _sparse(held[1]))
    out = np.zeros(words, np.uint64)
    for row in merged.toLocalIterator():
        out[row["page"] * PAGE : (row["page"] + 1) * PAGE] = _spread(bytes(row["twice"]))
    return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By bits that neither the place nor the mask of a filter uses alone."""
    return ((hashes >> np.uint64(24)) & np.uint64(shards - 1)).astype(np.int32)


def _shard_filters(rows: DataFrame, shards: int, words: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(shard, twice) and (shard, parts): each shard's filter of hashes that two documents hold, and into how many
    parts the documents that ask it are dealt. A batch of documents sends a hash once, with the number of its documents."""

    def send():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, n = np.unique(_batch_hashes(batch.column(1), min_chars)[0], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(shard_of(found, shards)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["shard", "hash", "n"])

        return step

    sent = keep(arrow_map(rows, "shard int, hash long, n long", send), "hashes")

    def build(batches):
        current, pair = None, None
        for batch in batches:
            shard = np.asarray(batch.column(0))
            hashes, n = np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shard[a] != current:
                    if pair is not None:
                        yield _packed(current, pair.twice)
                    current, pair = int(shard[a]), FilterPair(words)
                own = hashes[a:b]
                again = np.unique(own[n[a:b] > 1])
                pair.put(pair.twice, pair.places(again), pair.masks(again))
                pair.add(own)
        if pair is not None:
            yield _packed(current, pair.twice)

    filters = keep(sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, twice binary"), "filters")
    parts = sent.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.ceil(F.col("n") * BITS_A_LINE / (words * 64 * 4)).cast("int").alias("parts"))
    return filters, parts


def _packed(shard: int, twice: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())], names=["shard", "twice"])


def suspects_by_shard(rows: DataFrame, lines: int, min_chars: int, max_bits: int) -> DataFrame:
    """doc_id, digest of the lines that their shard's second filter holds."""
    shards = 1 << max(1, (BITS_A_LINE * lines // max_bits).bit_length())
    words = 1 << max(6, min(max_bits, 2 * BITS_A_LINE * lines // shards).bit_length() - 7)
    filters, parts = _shard_filters(rows, shards, words, min_chars)

    def ask():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, keys, counts = _batch_hashes(batch.column(1), min_chars)
            owner = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array([digest(k) for k in keys], pa.binary()), pa.array(hashes.view(np.int64)), pa.array(shard_of(hashes, shards))], names=["doc_id", "digest", "hash", "shard"])

        return step

    small = broadcast_if_small(parts, shards)
    asked = arrow_map(rows, "doc_id long, digest binary, hash long, shard int", ask).join(small, "shard")
    asked = asked.select("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("twice"), "doc_id", "digest", "hash")
    held = filters.join(small, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "twice", *(F.lit(None).cast(k).alias(c) for c, k in (("doc_id", "long"), ("digest", "binary"), ("hash", "long"))))
    dealt = asked.unionByName(held).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")

    def test(batches):
        pair = FilterPair(words)
        for batch in batches:
            kind = np.asarray(batch.column("kind"))
            borders = np.flatnonzero(kind == 0).tolist()
            for a, b in zip([0, *borders], [*borders, len(kind)], strict=True):
                if b > a and kind[a] == 0:
                    pair.twice = np.frombuffer(zlib.decompress(batch.column("twice")[a].as_py()), np.uint64)
                    a += 1
                if b > a:
                    some = batch.slice(a, b - a)
                    hashes = np.asarray(some.column("hash")).view(np.uint64)
                    masks = pair.masks(hashes)
                    hit = pa.array((pair.twice[pair.places(hashes)] & masks) == masks)
                    yield pa.RecordBatch.from_arrays([some.column("doc_id").filter(hit), some.column("digest").filter(hit)], names=["doc_id", "digest"])

    return dealt.mapInArrow(test, "doc_id long, digest binary")


def lines_to_drop(docs: DataFrame, min_chars: int = 10, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id and digests (array<binary>) of the keys whose lines go, for documents that lose any."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    lines = rows.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    keys = ["digest"]
    if BITS_A_LINE * lines > max_bits:
        suspects = keep(suspects_by_shard(rows, lines, min_chars, max_bits), "suspects")
    else:
        suspects, keys = keep(suspects_by_broadcast(rows, lines, min_chars, max_bits), "suspects"), ["digest", "key"]
    repeats = suspects.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("digest", "first", "n")
    return spread_join(suspects.select("doc_id", "digest"), repeats, "digest", "n").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))


def suspects_by_broadcast(rows: DataFrame, lines: int, min_chars: int, max_bits: int) -> DataFrame:
    """doc_id, digest and key of the lines that the second filter holds."""
    sent = rows.sparkSession.sparkContext.broadcast(twice_seen(rows, lines, min_chars, max_bits))

    def work():
        seen = FilterPair(64)
        seen.twice = sent.value
        seen.shift = np.uint64(64 - len(seen.twice).bit_length() + 1)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, keys, counts = _batch_hashes(batch.column(1), min_chars)
            masks = seen.masks(hashes)
            hit = np.flatnonzero((seen.twice[seen.places(hashes)] & masks) == masks)
            found = [keys[i] for i in hit.tolist()]
            owner = np.repeat(np.arange(len(counts)), counts)[hit]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array([digest(k) for k in found], pa.binary()), pa.array([k.decode() for k in found], pa.string())], names=["doc_id", "digest", "key"])

        return step

    return arrow_map(rows, "doc_id long, digest binary, key string", work)


def dedup_lines(docs: DataFrame, min_chars: int = 10, max_bits: int = MAX_BITS, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 for every row; carry names columns to pass through.

    with_text adds kept_text.
    """
    drops = keep(lines_to_drop(docs, min_chars, max_bits), "drops")
    size = drops.agg(F.sum(F.size("digests") * 32 + 32)).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *carry)
    joined = rows.join(F.broadcast(drops) if size <= BROADCAST_BYTES else drops, "doc_id", "left").select("doc_id", "text", "digests", *carry)
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*carry).schema)

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_lines, n_dropped, sha, kept = [], [], [], []
            for text, gone in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_buffer().to_pybytes()
                n = text.count(b"\n") + 1
                stay = text
                left = n
                if gone:
                    gone = {*gone}
                    lines = [line for line, key in zip(text.split(b"\n"), line_keys(text), strict=True) if digest(key) not in gone]
                    stay, left = b"\n".join(lines), len(lines)
                n_lines.append(n)
                n_dropped.append(n - left)
                sha.append(hashlib.sha256(stay).hexdigest())
                if with_text:
                    kept.append(stay.decode())
            made = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())] + [pa.array(kept, pa.string())] * with_text
            return pa.RecordBatch.from_arrays(made + [batch.column(3 + i) for i in range(len(carry))], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", *["kept_text"] * with_text, *carry])

        return step

    return arrow_map(joined, schema, work)


LINES_SQL = r"""
with l as (select doc_id, i, line, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
           from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents)),
  r as (select key, min(doc_id) as first from l where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
  d as (select l.*, r.key is not null and l.doc_id > r.first as gone from l left join r using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from d group by doc_id
"""
