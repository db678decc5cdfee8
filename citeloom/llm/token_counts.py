"""Token counts without ids: pieces are counted once per distinct pre-token.

Each task keeps a table (pre-token -> number of pieces). For a batch of documents it forms every
document's pre-token frequencies, counts the pieces of pre-tokens that the table lacks, joins the two
by pre-token and sums frequency * pieces. The join stays inside the task: dealing the frequencies out
by pre-token would shuffle several times the input.

Null and empty texts have 0 tokens. Rows are independent, so repeated rows, null ids and extra
columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_or_empty

# Fixed value: the public split pattern of this byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered by a task at most; beyond it the table starts anew, which changes no result.
TABLE_LIMIT = 250_000
#: Longer texts are split piece by piece, cut where a single space starts a pre-token.
SLICE = 1 << 20


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of text that no pre-token straddles: each cut stands before a lone space between words."""
    start = 0
    edge = regex.compile(r"(?<=\S) (?=\S)")
    while len(text) - start > size and (found := edge.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class PieceCounter:
    def __init__(self, tokenizer_file: str, limit: int = TABLE_LIMIT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.split = regex.compile(SPLIT)
        self.pieces: dict[str, int] = {}
        self.limit = limit

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies of a text, and how many special tokens it names."""
        counts: Counter = Counter()
        specials = 0
        parts = [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            specials = len(parts) - 1
        for part in parts:
            for piece in slices(part) if len(part) > SLICE else (part,):
                counts.update(self.split.findall(piece))
        return counts, specials

    def learn(self, wanted: set[str]) -> None:
        new = [w for w in wanted if w not in self.pieces]
        for at in range(0, len(new), 20_000):
            block = new[at : at + 20_000]
            for word, encoding in zip(block, self.tokenizer.encode_batch_fast(block, add_special_tokens=False), strict=True):
                self.pieces[word] = len(encoding)

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for at in range(0, len(texts), 256):
            block = [self.frequencies(t) for t in texts[at : at + 256]]
            if len(self.pieces) > self.limit:
                self.pieces.clear()
            self.learn(set().union(*(c for c, _ in block)))
            table = self.pieces
            out += [sum(n * table[w] for w, n in c.items()) + specials for c, specials in block]
        return out


def token_counts(docs: DataFrame, tokenizer_file: str, max_tokens: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > max_tokens) for every row of docs."""

    def work():
        counter = PieceCounter(tokenizer_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = counter.count(batch.column(2).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

        return step

    text = text_or_empty()
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = arrow_map(rows, "doc_id long, n_bytes long, n_tokens long", work)
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
