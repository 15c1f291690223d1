"""Token counts of whole texts by looking up the lengths of their pre-tokens.

A text is cut into pre-tokens with the tokenizer's own pattern, and its count
is the sum of their token counts.  Two tiers hold the lengths: a table of the
frequent pre-tokens, broadcast to every worker, and a cache in each worker for
the rest, filled by the tokenizer.  Pre-tokens are never shuffled.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import utf8, whole_texts

# The pre-token pattern of byte-level BPE, as the tokenizer's library states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that every Unicode version files alike.  Pieces with others are cut and counted by the library itself.
UNUSUAL = regex.compile(r"[^\t-\r\x20-\x7e\xa1-ɏЀ-ӿ‐-‧€]")
# Whatever the characters around, a pre-token begins at a single space between two of these, and nothing before it matters behind it.
PIECE_START = re.compile(r"(?<=[\x21-\x7e\xa1-ɏЀ-ӿ‐-‧€])(?= [\x21-\x7e\xa1-ɏЀ-ӿ‐-‧€])")
CACHED_CHARS = 64  # longer pre-tokens hardly come again, and are not kept
FREQUENT = 65_536  # entries of the broadcast table: a few MB
SAMPLE_ROWS = 2_000  # rows that the frequent pre-tokens are taken from; they only decide what is cached where
CACHE_ENTRIES = 400_000  # of a worker's cache, which is emptied when full
ROWS_AT_ONCE = 512


class Tokens:
    """Counts the tokens of texts; ``table`` holds known lengths."""

    def __init__(self, path: str, table: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.pattern = regex.compile(PATTERN)
        self.lengths = Lengths(table, self.length)

    def length(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):
            return self.length(text)
        if not UNUSUAL.search(text):
            return self.looked_up(text)
        return sum(self.lengths[p] if UNUSUAL.search(p) else self.looked_up(p) for p in PIECE_START.split(text))

    def looked_up(self, text: str) -> int:
        return sum(map(self.lengths.__getitem__, self.pattern.findall(text)))


class Lengths(dict):
    """The frequent lengths, with a bounded cache behind them."""

    def __init__(self, table: dict[str, int], measure):
        super().__init__(table)
        self.cache: dict[str, int] = {}
        self.measure = measure

    def __missing__(self, pre_token: str) -> int:
        n = self.cache.get(pre_token)
        if n is None:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            n = self.measure(pre_token)
            if len(pre_token) <= CACHED_CHARS:
                self.cache[pre_token] = n
        return n


_workers: dict[object, Tokens] = {}


def worker(path: str, key: object, table: dict[str, int]) -> Tokens:
    """The counter of this Python worker, kept from one task to the next."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = Tokens(path, table)
    return _workers[key]


def frequent_lengths(spark: SparkSession, docs: DataFrame, path: str, text_col: str) -> dict[str, int]:
    """Lengths of the ``FREQUENT`` commonest pre-tokens of some ``SAMPLE_ROWS`` rows, counted where they lie."""
    rows = docs.count()
    if not rows:
        return {}

    def most_common(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, seen = regex.compile(PATTERN), Counter()
        for batch in source:
            for text in batch.column(0).to_pylist():
                seen.update(pattern.findall((text or b"").decode("utf-8", "replace")))
        common = [(w, n) for w, n in seen.most_common(FREQUENT) if len(w) <= CACHED_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in common], pa.string()), pa.array([n for _, n in common], pa.int64())], ["pre_token", "n"])

    sample = whole_texts(docs).select(utf8(text_col).alias("text")).sample(False, min(1.0, SAMPLE_ROWS / rows), seed=7)
    counted = sample.mapInArrow(most_common, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    common = counted.orderBy(F.desc("n"), "pre_token").limit(FREQUENT).collect()
    tokens = Tokens(path, {})
    return {r["pre_token"]: tokens.length(r["pre_token"]) for r in common}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row, with the tokenizer file at ``tokenizer_path`` on every worker.

    Equal to the library's count without added special tokens; special strings
    inside a text count as the library takes them by default.  Null and empty
    texts have no bytes and no tokens.  Ids may be null or repeated, rows too;
    an empty table gives no rows.  A character that Unicode versions may file
    unlike sends only the piece around it to the library, from one space to the next.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(spark, docs, tokenizer_path, text_col))
    key = os.urandom(8)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker(tokenizer_path, key, table.value)
        for whole in source:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                texts = batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()),
                    pa.array([tokens.count((t or b"").decode("utf-8", "replace")) for t in texts], pa.int64()),
                ], ["id", "n_bytes", "n_tokens"])

    source = whole_texts(docs).select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n_bytes long, n_tokens long")
