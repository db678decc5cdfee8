"""BPE encoding and decoding over a contiguous array of adjacent ranks.

A word starts as one part per symbol. Two arrays run side by side: part boundaries, and the merge rank
of each part with its right neighbour. The smallest rank is found by a scan, its boundary is deleted,
and only the ranks of the two neighbours are looked up again. Words of over LONG_WORD symbols would
make the scan quadratic, so they use a heap over linked parts, with the same order of merges.

The vocabulary is a `tokenizers` file with word ends ("</w>"), NFC, lower case and dropped white
space. Null and empty texts have no ids and decode to ''. Rows are independent: repeated rows, null
ids and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, text_or_empty
from .token_counts import slices

# Fixed value: the public split pattern of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters on which all Unicode versions agree (Latin letters and signs); NFC leaves them alone.
PLAIN = re.compile("[^\x00-ɏ]")
LONG_WORD = 128
#: Words remembered by a task at most; beyond it the table starts anew, which changes no result.
TABLE_LIMIT = 120_000
NO_MERGE = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself if printable Latin-1, else the next free sign from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def merge_scan(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    parts = list(symbols)
    adjacent = [ranks.get(pair, NO_MERGE) for pair in zip(parts, parts[1:])]
    while adjacent:
        best = min(adjacent)
        if best == NO_MERGE:
            break
        i = adjacent.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del adjacent[i]
        if i:
            adjacent[i - 1] = ranks.get((parts[i - 1], parts[i]), NO_MERGE)
        if i < len(adjacent):
            adjacent[i] = ranks.get((parts[i], parts[i + 1]), NO_MERGE)
    return parts


def merge_heap(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    parts: list[str | None] = list(symbols)
    after = [*range(1, len(parts)), -1]
    before = [*range(-1, len(parts) - 1)]
    heap = [(r, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(pair)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j < 0 or parts[j] != right:
            continue
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := ranks.get((parts[a], parts[b]))) is not None:
                heapq.heappush(heap, (r, a, (parts[a], parts[b])))
    return [p for p in parts if p is not None]


class WordBPE:
    def __init__(self, tokenizer_file: str, limit: int = TABLE_LIMIT):
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.symbols = byte_symbols()
        self.library = Tokenizer.from_file(tokenizer_file)
        self.split = regex.compile(SPLIT)
        self.table: dict[str, bytes] = {}
        self.limit = limit

    def words(self, text: str) -> list[str]:
        """Normalised words. Other scripts take the library's own tables, whose Unicode version counts."""
        if PLAIN.search(text) is None:
            return self.split.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_word(self, word: str) -> bytes:
        symbols = [self.symbols[b] for b in word.encode()]
        symbols[-1] += self.end
        merge = merge_scan if len(symbols) <= LONG_WORD else merge_heap
        return np.array([self.vocab[p] for p in merge(symbols, self.ranks)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.table) > self.limit:
            self.table.clear()
        table, out = self.table, []
        for k, part in enumerate(self.special_split.split(text)):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            for piece in slices(part):
                words = self.words(piece)
                for w in {*words}.difference(table):
                    table[w] = self.encode_word(w)
                out += map(table.__getitem__, words)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary file names no decoder: tokens are joined by blanks, word ends stay."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe_round_trip(docs: DataFrame, tokenizer_file: str, outputs: tuple[str, ...] = ("ids_sha256", "decoded_sha256")) -> DataFrame:
    """doc_id, n_tokens and the wanted outputs of every row of docs.

    outputs: any of ids (array<int>), decoded (string), ids_sha256, decoded_sha256.
    """
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def work():
        bpe = WordBPE(tokenizer_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, found = [], {k: [] for k in outputs}
            for value in batch.column(1):
                ids = bpe.encode(value.as_py())
                n.append(len(ids) // 4)
                decoded = bpe.decode(ids)
                made = {"ids": lambda: np.frombuffer(ids, "<i4").tolist(), "decoded": lambda: decoded, "ids_sha256": lambda: hashlib.sha256(ids).hexdigest(), "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest()}
                for k in outputs:
                    found[k].append(made[k]())
            types = {"ids": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(found[k], types.get(k, pa.string())) for k in outputs)], names=["doc_id", "n_tokens", *outputs])

        return step

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return arrow_map(rows, ", ".join(["doc_id long", "n_tokens long", *(f"{k} {kinds[k]}" for k in outputs)]), work)
