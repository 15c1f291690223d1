"""Scoring texts with a bigram model by deleted interpolation.

The probability of a token is a mixture of its bigram and unigram
maximum-likelihood estimates and of a uniform one.  The mixture weights depend
on how often the context was seen, and are learned by expectation-maximisation
on training texts whose counts are held out.

Counts travel packed.  A block of texts sends each of its distinct n-grams
once, with its count in the block, to the partition of the n-gram's hash.
There the counts of all blocks are added up, and every block gets the totals
of its n-grams back in the order in which it sent them.  So a frequent n-gram
costs one entry per block, and no n-gram has a group of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import stored
from .common import utf8, whole_texts, words

BLOCK_BYTES = 8 << 20  # of texts whose n-grams are counted together before they are sent; one longer text is a block
PARTITION_BYTES = 16 << 20  # of text for each partition of hashes
HELD_OUT = 10  # one in so many training texts teaches the weights; its counts join the rest afterwards
BUCKETS = 32  # of context frequency, by powers of two; bucket 0 is for contexts never seen
CELL = 16  # cells of each doubling of an estimate, for the counts that weights are learned from
EM_STEPS = 50
# No word contains a space, so these two are no words.
END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(t)) for t in (b" end", b" begin"))
MEMO_WORDS = 300_000
LEVELS = 2


class Hashes(dict):
    """Hash of each word, kept for the next block; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


@dataclass
class Block:
    """Consecutive rows of a task.  ``kind``: 0 not for training, 1 training, 2 training with counts held out."""

    number: int
    ids: list
    kinds: np.ndarray
    texts: list[bytes]


def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Cut a task's rows ``(id, text, kind)`` into blocks; the same rows always give the same blocks."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 24
    ids, kinds, texts, size = [], [], [], 0
    for batch in source:
        for i, text, kind in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(i)
            kinds.append(kind)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield Block(number, ids, np.array(kinds), texts)
                number, ids, kinds, texts, size = number + 1, [], [], [], 0
    if ids:
        yield Block(number, ids, np.array(kinds), texts)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[bytes], memo: Hashes) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash of the unigram and of the bigram that ends at each token, and the number of tokens of each text."""
    parts, lengths = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = words(text)
        lengths[i] = len(found) + 1
        parts.append(np.fromiter(map(memo.__getitem__, found), np.uint64, len(found)))
        parts.append(np.array([END]))
    token = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    context = np.roll(token, 1)
    context[np.cumsum(lengths) - lengths] = BEGIN
    return [token, mixed(context * np.uint64(0x9E3779B97F4A7C15) + token)], lengths


def packed(parts: list[bytes]) -> bytes:
    return b"".join([np.array([len(p) for p in parts], np.int64).tobytes(), *parts])


def unpacked(data: bytes, parts: int) -> list[bytes]:
    ends = 8 * parts + np.cumsum(np.frombuffer(data, np.int64, parts))
    return [data[e - n:e] for e, n in zip(ends, np.frombuffer(data, np.int64, parts))]


def packed_hashes(ascending: np.ndarray) -> bytes:
    """Sorted hashes as steps of as few bytes as the largest step needs."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    first, steps = steps[:1], steps[1:]
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + first.tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_hashes(data: bytes) -> np.ndarray:
    if len(data) == 1:
        return np.zeros(0, np.uint64)
    steps = np.zeros(((len(data) - 9) // data[0], 8), np.uint8)
    steps[:, :data[0]] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, 1), steps.view(np.uint64).ravel()]), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts byte by byte, the low bytes of all first, and as many bytes of each as the largest needs."""
    octets = counts.astype("<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, -(-int(counts.max()).bit_length() // 8)) if len(counts) else 1
    return bytes([width]) + zlib.compress(octets[:, :width].T.tobytes(), 1)


def unpacked_counts(data: bytes) -> np.ndarray:
    by_byte = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    octets = np.zeros((by_byte.shape[1], 8), np.uint8)
    octets[:, :data[0]] = by_byte.T
    return octets.view("<u8").ravel()


def partition_bounds(ascending: np.ndarray, partitions: int) -> np.ndarray:
    """Where each of the equal ranges of hashes begins among sorted ones, and where the last ends."""
    home = (ascending >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)
    return np.searchsorted(home, np.arange(partitions + 1, dtype=np.uint64))


SENT, ANSWERED = 3, 2  # parts by level: hashes, retained and held-out counts; and the two counts


def send(source: Iterator[pa.RecordBatch], partitions: int) -> Iterator[pa.RecordBatch]:
    memo = Hashes()
    for block in blocks(source):
        keys, lengths = grams(block.texts, memo)
        kind = np.repeat(block.kinds, lengths)
        levels, bounds = [], []
        for key in keys:
            distinct, place = np.unique(key, return_inverse=True)
            levels.append((distinct, *(np.bincount(place[kind == k], minlength=len(distinct)) for k in (1, 2))))
            bounds.append(partition_bounds(distinct, partitions))
        rows = []
        for p in range(partitions):
            parts = []
            for (distinct, retained, held), b in zip(levels, bounds):
                span = slice(b[p], b[p + 1])
                parts += [packed_hashes(distinct[span]), packed_counts(retained[span]), packed_counts(held[span])]
            if any(b[p] < b[p + 1] for b in bounds):
                rows.append({"part": p, "block": block.number, "data": packed(parts)})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("block", pa.int64()), ("data", pa.binary())]))


def add_up(table: pa.Table) -> pa.Table:
    """Totals of one partition of hashes, for each block that sent some.

    ``owned`` counts the unigrams seen in training once over all blocks: each belongs to the first block listed here.
    """
    block = table.column("block").to_pylist()
    sent = [unpacked(d, SENT * LEVELS) for d in table.column("data").to_pylist()]
    answers: list[list[bytes]] = [[] for _ in block]
    owned = np.zeros(len(block), np.int64)
    for level in range(LEVELS):
        hashes = [unpacked_hashes(s[SENT * level]) for s in sent]
        counts = [np.concatenate([unpacked_counts(s[SENT * level + i]) for s in sent]) for i in (1, 2)]
        distinct, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        totals = [np.bincount(place, weights=c, minlength=len(distinct)) for c in counts]
        starts = np.cumsum([0, *map(len, hashes)])
        if level == 0:
            seen = first[(totals[0] + totals[1]) > 0]
            owned += np.bincount(np.searchsorted(starts, seen, side="right") - 1, minlength=len(block))
        for i in range(len(block)):
            at = place[starts[i]:starts[i + 1]]
            answers[i] += [packed_counts(t[at]) for t in totals]
    return pa.table({
        "block": pa.array(block, pa.int64()), "part": pa.array(table.column("part").to_pylist(), pa.int32()),
        "owned": pa.array(owned), "data": pa.array([packed(a) for a in answers], pa.binary())})


def ship(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each block in one compressed row, to meet the block's totals."""
    for block in blocks(source):
        yield pa.RecordBatch.from_pylist([{
            "block": block.number, "ids": block.ids, "kinds": block.kinds.tolist(), "sizes": [len(t) for t in block.texts],
            "texts": zstandard.compress(b"".join(block.texts), 3)}], SHIPPED)


SHIPPED = pa.schema([
    ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])
COUNTED = pa.schema([("id", pa.int64()), ("kind", pa.int32()), ("n_tokens", pa.int64()), ("owned", pa.int64()), ("counts", pa.binary())])


def counted(shipped: pa.Table, answers: pa.Table, partitions: int) -> pa.Table:
    """Per text, the totals of the n-grams that end at each token: all training counts, then the retained ones of held-out texts."""
    rows = []
    parts, datas = answers.column("part").to_pylist(), answers.column("data").to_pylist()
    for block in shipped.to_pylist():
        data, ends = zstandard.decompress(block["texts"], sum(block["sizes"])), np.cumsum(block["sizes"])
        texts = [data[e - n:e] for e, n in zip(ends, block["sizes"])]
        keys, lengths = grams(texts, Hashes())
        places, totals = [], []
        for key in keys:
            distinct, place = np.unique(key, return_inverse=True)
            places.append((place, partition_bounds(distinct, partitions)))
            totals.append(np.zeros((2, len(distinct)), np.uint64))
        for p, answer in zip(parts, datas):
            found = [unpacked_counts(c) for c in unpacked(answer, ANSWERED * LEVELS)]
            for level, (_, bounds) in enumerate(places):
                span = slice(bounds[p], bounds[p + 1])
                if span.stop - span.start != len(found[ANSWERED * level]):
                    raise RuntimeError("the input was cut into other blocks while its n-grams were counted")
                totals[level][0, span], totals[level][1, span] = found[ANSWERED * level:ANSWERED * (level + 1)]
        per_token = [[t[0][place], t[1][place]] for t, (place, _) in zip(totals, places)]
        owned, end = sum(answers.column("owned").to_pylist()), 0
        for i, kind, n in zip(block["ids"], block["kinds"], lengths.tolist()):
            span = slice(end, end + n)
            arrays = [retained[span] + held[span] for retained, held in per_token] + [retained[span] for retained, _ in per_token if kind == 2]
            rows.append({"id": i, "kind": kind, "n_tokens": n, "owned": owned, "counts": packed_counts(np.concatenate(arrays))})
            owned, end = 0, end + n
    return pa.Table.from_pylist(rows, COUNTED)


def token_counts(row_counts: bytes, n: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Unigram and bigram counts by token; ``first`` is 0 for all counts and 2 for the retained ones."""
    flat = unpacked_counts(row_counts)
    return flat[first * n:(first + 1) * n].astype(float), flat[(first + 1) * n:(first + 2) * n].astype(float)


def estimates(one: np.ndarray, two: np.ndarray, texts: int, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram and unigram estimate of each token, and the bucket of its context.

    A word is followed by a token wherever it stands, so its count is that of the context; the begin is seen once a text.
    """
    context = np.concatenate([[float(texts)], one[:-1]])
    bigram = np.divide(two, context, out=np.zeros_like(two), where=context > 0)
    bucket = np.minimum(np.floor(np.log2(np.maximum(context, 0.5))) + 1, BUCKETS - 1).astype(np.int64)
    return bigram, one / max(tokens, 1), bucket


def mixture_weights(cells: pd.DataFrame, vocabulary: int) -> np.ndarray:
    """Weights (bucket x bigram, unigram, uniform) by EM over ``cells(bucket, two, one, n)`` of quantised estimates."""
    weights = np.tile([0.6, 0.3, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.75, 0.25]
    if len(cells):
        bucket, n = cells["bucket"].to_numpy(np.int64), cells["n"].to_numpy(float)

        def value(cell: pd.Series) -> np.ndarray:
            c = cell.to_numpy(float)
            return np.where(c < 0, 0.0, 2.0 ** (-c / CELL))
        p = np.stack([value(cells["two"]), value(cells["one"]), np.full(len(cells), 1 / (vocabulary + 1))], axis=1)
        start = weights.copy()
        for _ in range(EM_STEPS):
            share = weights[bucket] * p
            share *= (n / share.sum(axis=1))[:, None]
            sums = np.stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + start
            weights = sums / sums.sum(axis=1, keepdims=True)
    weights[0, 0] = 0.0
    weights[0] /= weights[0].sum()
    return weights


def score(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    ``is_training`` is a condition on ``id``.  Scores are log10 probabilities
    of whole texts, an end token included: ``base_score`` by add-one unigrams,
    ``score`` by the interpolated model, whose probabilities over all known
    tokens and one unknown add up to 1.  Null texts are empty ones; null and
    repeated ids are rows like others.  Without training rows all tokens are
    unknown.  An empty table gives no rows.

    Counts of n-grams saturate at 2**31.  ``docs`` is read twice and must come
    in the same partitions both times, as a stored table does; other input is
    noticed and refused.
    """
    training = F.coalesce(is_training, F.lit(False))
    held = training & (F.pmod(F.xxhash64("id", F.lit("held-out")), F.lit(HELD_OUT)) == 0)
    rows = whole_texts(docs).select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).withColumn(
        "kind", F.when(held, 2).when(training, 1).otherwise(0))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    partitions = max(8, -(-size // PARTITION_BYTES))

    sent = rows.mapInArrow(lambda source: send(source, partitions), "part int, block long, data binary")
    answers = sent.groupBy("part").applyInArrow(add_up, "block long, part int, owned long, data binary")
    shipped = rows.mapInArrow(ship, "block long, ids array<long>, kinds array<int>, sizes array<long>, texts binary")
    known = stored(shipped.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda texts, totals: counted(texts, totals, partitions), "id long, kind int, n_tokens long, owned long, counts binary"), "counted")

    kind = F.col("kind")
    total = known.agg(
        F.sum("owned").alias("v"), F.sum(F.when(kind > 0, F.col("n_tokens"))).alias("n"), F.count(F.when(kind > 0, True)).alias("texts"),
        F.sum(F.when(kind == 1, F.col("n_tokens"))).alias("kept_n"), F.count(F.when(kind == 1, True)).alias("kept_texts")).first()
    v, n, texts, kept_n, kept_texts = (int(x or 0) for x in total)

    def learn(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            cells = []
            for tokens, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                two, one, bucket = estimates(*token_counts(counts, tokens, 2), kept_texts, kept_n)
                quantised = [np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * CELL), -1).astype(np.int64) for p in (two, one)]
                cells.append((bucket << 32) | ((quantised[0] + 1) << 16) | (quantised[1] + 1))
            cell, times = np.unique(np.concatenate(cells) if cells else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(cell >> 32), pa.array((cell >> 16 & 0xFFFF) - 1), pa.array((cell & 0xFFFF) - 1), pa.array(times)], ["bucket", "two", "one", "n"])

    # at most BUCKETS x (CELL x 64)^2 cells whatever the input, and some ten thousand in practice
    cells = known.filter(kind == 2).select("n_tokens", "counts").mapInArrow(learn, "bucket long, two long, one long, n long").groupBy(
        "bucket", "two", "one").agg(F.sum("n").alias("n")).toPandas()
    weights = mixture_weights(cells, v)

    def rate(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for tokens, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                one, two = token_counts(counts, tokens, 0)
                bigram, unigram, bucket = estimates(one, two, texts, n)
                w = weights[bucket]
                p = w[:, 0] * bigram + w[:, 1] * unigram + w[:, 2] / (v + 1)
                out.append((int((one > 0).sum()), float(np.log10((one + 1) / (n + v + 1)).sum()), float(np.log10(p).sum())))
            known_, base, own = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(known_, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())],
                ["id", "n_tokens", "n_known", "base_score", "score"])

    scored = known.select("id", "n_tokens", "counts").mapInArrow(rate, "id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
