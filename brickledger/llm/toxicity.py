"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

Voters are word lists, patterns, and word stems mined from labelled rows; each
votes or abstains.  The label model is a latent class with one vote rate per
voter and class and a tree of pairwise dependences between voters, fitted by
expectation-maximisation over the counts of all vote patterns.  The human
label, where there is one, is a further voter of stated accuracy, which ties
the latent class to what the labels mean.  A logistic regression learns the posterior from words and
stems, and alone scores texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import stored
from .common import map_rows, utf8, whole_texts

# Common insults and words of contempt, by language.
LEXICONS = {
    "en_insult": "idiot moron stupid dumb imbecile fool jerk loser clown scumbag bastard asshole bitch dickhead retard",
    "en_contempt": "worthless pathetic disgusting trash scum garbage filth vermin vile repulsive despicable hateful",
    "de_insult": "idiot trottel dummkopf depp vollidiot arschloch schwachkopf hurensohn wichser mistkerl",
    "de_contempt": "abschaum dreck widerlich erbärmlich wertlos ekelhaft nutzlos lächerlich",
    "fr_insult": "idiot imbécile crétin abruti connard salaud débile bouffon ordure salope",
    "fr_contempt": "minable pathétique dégoûtant répugnant ignoble racaille vermine méprisable",
    "es_insult": "idiota imbécil estúpido tonto cretino payaso cabrón gilipollas pendejo basura",
    "es_contempt": "patético asqueroso repugnante despreciable escoria inútil miserable",
}
LEET = str.maketrans("013457@$!*", "oieastasi*")
PATTERN_VOTERS = ["disguised", "stretched", "shouted", "repeated", "dense", "addressed", "quiet"]
ADDRESS = frozenset("you du tu vous eres ihr".split())
ADDRESS_REACH = 4  # a listed word is addressed if one of so many words before it is an address
STEM_LENGTHS = (4, 5, 6, 7, 8)
DENSE = 0.004  # share of a text's words from which a stem counts as present: stems are part of harmless words too
EDGES = ".,;:!?()[]{}\"'«»“”‘’…"

LABELLED_ROWS = 16_000  # labelled rows that stems and classifier are fitted on
FEATURES = 1_024  # words and stems with a weight
STEM_VOTERS = 40  # all voters fit into the bits of a long
LEAST_DOCS = 4
LABEL_RIGHT = (0.999, 0.99)  # P(label | class), clean and toxic
EM_STEPS = 25
MEMO_WORDS = 150_000


def plain_words(text: str) -> list[str]:
    return [w for w in (t.strip(EDGES) for t in text.split()) if w]


def features_of(word: str) -> list[str]:
    """The word itself, and its stems marked with a dash."""
    return [word, *(f"{word[:n]}-" for n in STEM_LENGTHS if len(word) >= n)]


class Memo(dict):
    """What is known of a word, kept for the next text; emptied when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= MEMO_WORDS:
            self.clear()
        made = self[word] = self.make(word)
        return made


class Voters:
    def __init__(self, stems: list[str]):
        self.names = [*LEXICONS, *PATTERN_VOTERS, *stems]
        self.bit = {name: 1 << i for i, name in enumerate(self.names)}
        self.lists: dict[str, int] = {}
        for name, line in LEXICONS.items():
            for word in line.split():
                self.lists[word] = self.lists.get(word, 0) | self.bit[name]
        self.stems = {s: self.bit[s] for s in stems}
        self.memo = Memo(self.votes_of)

    def votes_of(self, word: str) -> tuple[int, bool, tuple[int, ...], bool]:
        """Votes of one word, whether it stands in a list in whatever guise, the votes of its stems, and whether it is an address."""
        low = word.lower()
        votes = self.lists.get(low, 0)
        listed = votes > 0
        if not listed and any(c in "013457@$!*" for c in low) and low.translate(LEET) in self.lists:
            votes, listed = votes | self.bit["disguised"], True
        if not listed and (short := re.sub(r"(.)\1{2,}", r"\1", low)) != low and short in self.lists:
            votes, listed = votes | self.bit["stretched"], True
        if listed and len(word) > 3 and word.isupper():
            votes |= self.bit["shouted"]
        return votes, listed, tuple(self.stems[name] for name in features_of(low) if name in self.stems), low in ADDRESS

    def votes(self, text: str) -> int:
        found = plain_words(text)
        votes = listed = 0
        stems, address = Counter(), -ADDRESS_REACH - 1
        for at, word in enumerate(found):
            own, known, begun, addresses = self.memo[word]
            votes |= own
            if begun:
                stems.update(begun)
            if known:
                listed += 1
                if at - address <= ADDRESS_REACH:
                    votes |= self.bit["addressed"]
            if addresses:
                address = at
        for bit, n in stems.items():
            if n >= DENSE * len(found):
                votes |= bit
        if listed >= 3:
            votes |= self.bit["repeated"]
        if listed and listed >= 0.02 * len(found):
            votes |= self.bit["dense"]
        return votes or self.bit["quiet"]


# --------------------------------------------------------------- label model

@dataclass
class LabelModel:
    """P(class), by the labels there are, and P(vote | class, vote of its parent) for each voter."""

    prior: float
    rate: np.ndarray  # voter x class x vote of the parent (0 if it has none)
    parent: np.ndarray  # index of the parent, or -1
    correlation: dict[tuple[int, int], float] = field(default_factory=dict)

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic) of rows; ``votes`` is 0/1 by voter, ``label`` is -1 where there is none.

        An abstention says nothing: what toxic texts have in common is not
        that every list and stem occurs in them.
        """
        log = np.log([1 - self.prior, self.prior]) + np.zeros((len(votes), 2))
        for i in range(votes.shape[1]):
            above = votes[:, self.parent[i]] if self.parent[i] >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                p = self.rate[i, y, above]
                log[:, y] += np.where(votes[:, i] == 1, np.log(p), 0.0)
        for y in (0, 1):
            right = np.where(label == y, LABEL_RIGHT[y], 1 - LABEL_RIGHT[y])
            log[:, y] += np.where(label >= 0, np.log(right), 0.0)
        top = log.max(axis=1, keepdims=True)
        weight = np.exp(log - top)
        return weight[:, 1] / weight.sum(axis=1)


def unpacked(votes: np.ndarray, voters: int) -> np.ndarray:
    return (votes[:, None] >> np.arange(voters) & 1).astype(int)


def smoothed(hits: np.ndarray | float, all_: np.ndarray | float):
    return np.clip((hits + 0.1) / (all_ + 1.0), 1e-6, 1 - 1e-6)


def dependence_tree(joint: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], float]]:
    """The strongest tree of pairwise dependences given the class: parents, and the correlation of each edge.

    ``joint[y]`` holds expected counts of two votes together, with single votes on its diagonal.
    """
    m = joint.shape[1]
    strength, linear = np.zeros((m, m)), np.zeros((m, m))
    for y in (0, 1):
        t = max(total[y], 1e-9)
        one = np.clip(np.diag(joint[y]) / t, 1e-9, 1 - 1e-9)
        both = np.clip(joint[y] / t, 0, 1)
        cells = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): 1 - one[:, None] - one[None, :] + both}
        for (a, b), p in cells.items():
            q = (one if a else 1 - one)[:, None] * (one if b else 1 - one)[None, :]
            p = np.clip(p, 1e-12, 1)
            strength += t * p * np.log(p / q)
        linear += t / max(total.sum(), 1e-9) * (both - one[:, None] * one[None, :]) / np.sqrt(np.outer(one * (1 - one), one * (1 - one)))
    parent, edges = np.full(m, -1), {}
    inside, best, via = np.zeros(m, bool), np.full(m, -np.inf), np.zeros(m, int)
    at = 0
    for _ in range(m):
        inside[at] = True
        better = strength[at] > best
        best, via = np.where(better, strength[at], best), np.where(better, at, via)
        left = np.where(inside, -np.inf, best)
        if not (~inside).any():
            break
        at = int(np.argmax(left))
        if left[at] > 4.0:  # nats: more than chance would give
            parent[at] = via[at]
            edges[int(via[at]), at] = float(linear[via[at], at])
    return parent, edges


def fit_label_model(patterns: DataFrame, voters: int) -> LabelModel:
    """EM over ``patterns(votes, label, n)``.  A step is one pass that returns two voter-by-voter matrices per task."""
    shares = dict(patterns.filter("label >= 0").groupBy("label").agg(F.sum("n")).collect())
    prior = float(np.clip((shares.get(1, 0) + 1) / (sum(shares.values()) + 10), 1e-4, 0.6))
    model = LabelModel(prior, np.zeros((voters, 2, 2)), np.full(voters, -1))
    model.rate[:, 0], model.rate[:, 1] = 0.01, 0.2
    schema = "sums array<double>"
    for step in range(EM_STEPS):
        current = patterns.sparkSession.sparkContext.broadcast(model)

        def expect(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            joint, total = np.zeros((2, voters, voters)), np.zeros(2)
            for batch in source:
                votes = unpacked(batch.column(0).to_numpy(), voters)
                label = batch.column(1).to_numpy()
                n = batch.column(2).to_numpy().astype(float)
                toxic = current.value.posterior(votes, label)
                for y, p in ((0, 1 - toxic), (1, toxic)):
                    w = n * p
                    joint[y] += (votes * w[:, None]).T @ votes
                    total[y] += w.sum()
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([joint.ravel(), total])], pa.list_(pa.float64()))], ["sums"])

        # summed by place, so that the driver gets one row whatever the number of tasks
        parts = patterns.mapInArrow(expect, schema).select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("sum"))
        sums = parts.orderBy("pos").toPandas()["sum"].to_numpy()
        if not len(sums):
            return model
        joint = sums[:2 * voters * voters].reshape(2, voters, voters)
        total = sums[-2:]
        single = np.stack([np.diag(joint[0]), np.diag(joint[1])], axis=1)
        parent, edges = dependence_tree(joint, total) if step >= EM_STEPS // 2 else (model.parent, model.correlation)
        rate = np.empty_like(model.rate)
        for i in range(voters):
            for y in (0, 1):
                if parent[i] < 0:
                    rate[i, y] = smoothed(single[i, y], total[y])
                else:
                    with_parent, both = single[parent[i], y], joint[y, parent[i], i]
                    # the plain rate stands behind both, for parents that hardly ever vote
                    plain = smoothed(single[i, y], total[y])
                    rate[i, y, 1] = np.clip((both + 2 * plain) / (with_parent + 2), 1e-6, 1 - 1e-6)
                    rate[i, y, 0] = np.clip((single[i, y] - both + 2 * plain) / (total[y] - with_parent + 2), 1e-6, 1 - 1e-6)
        model = LabelModel(prior, rate, parent, edges)
    return model


# ---------------------------------------------------------------- classifier

def strength(n: int, words: int) -> float:
    """Value of a feature that ``n`` of a text's words have: it depends on their share."""
    return math.log1p(n / words / DENSE)


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def score(self, text: str, memo: Memo) -> float:
        found, counts = plain_words(text), Counter()
        for word in found:
            if own := memo[word]:
                counts.update(own)
        z = self.bias + sum(self.weights[f] * strength(n, len(found)) for f, n in counts.items())
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    def known(self, word: str) -> tuple[str, ...]:
        return tuple(f for f in features_of(word.lower()) if f in self.weights)


def fit_classifier(rows: list[tuple[dict[int, float], float]], features: int, penalty: float = 1.0,
                   steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by accelerated gradient steps."""
    n = len(rows)
    row = np.repeat(np.arange(n), [len(x) for x, _ in rows])
    col = np.array([c for x, _ in rows for c in x], np.int64)
    val = np.array([v for x, _ in rows for v in x.values()], float)
    target = np.array([y for _, y in rows])
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    weight = target / (2 * share) + (1 - target) / (2 * (1 - share))  # both classes weigh the same
    w, m, v = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=val * w[col], minlength=n) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / n
        grad = np.append(np.bincount(col, weights=val * error[row], minlength=features)[:features], error.sum())
        grad[:-1] += penalty / n * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


# ------------------------------------------------------------------ operator

@dataclass
class ToxicityModel:
    classifier: Classifier
    label_model: LabelModel
    voters: list[str]


def decoded(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> ToxicityModel:
    """Learn from the rows of ``docs`` that ``is_training`` holds for, and the labels that some of them have.

    ``is_training`` is a condition on ``id``.  The label model covers all
    training rows; stems and classifier are fitted on ``LABELLED_ROWS``
    labelled ones, or a tenth more, one of each id.  An id with several labels has their
    majority; null labels and ids are none.  Without labelled rows of both
    kinds the lists alone decide.
    """
    spark = docs.sparkSession
    texts = whole_texts(docs).select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).filter(F.coalesce(is_training, F.lit(False)))
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).dropna().groupBy("id").agg(
        (F.avg("label") >= 0.5).cast("int").alias("label")).filter(is_training)
    parts = max(1, -(-given.count() // LABELLED_ROWS))
    # within the bound and a tenth, and the same rows in every run
    chosen = given.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).limit(LABELLED_ROWS * 11 // 10)
    # one row per id, so the sample is bounded, and spread over tasks
    sample = stored(texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("label", "text"), "labelled")

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        memo = Memo(lambda w: features_of(w.lower()))
        for batch in source:
            for label, text in zip(batch.column(0).to_pylist(), decoded(batch.column(1))):
                found, own = plain_words(text), Counter()
                for w in found:
                    own.update(memo[w])
                seen[label].update(f for f, n in own.items() if n >= DENSE * len(found))
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), *(pa.array([s[f] for f in names], pa.int64()) for s in seen)], ["feature", "clean", "toxic"])

    totals = dict(sample.groupBy("label").count().collect())
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    listed = sorted({w for line in LEXICONS.values() for w in line.split()})
    counts = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("clean") + F.col("toxic") >= LEAST_DOCS)
    gap = F.col("toxic") / max(1, n_toxic) - F.col("clean") / max(1, n_clean)
    share = (F.col("toxic") + F.col("clean")) / max(1, n_clean + n_toxic)
    best = counts.withColumn("chi", gap * gap / (share * (1 - share) + 1e-9)).orderBy(F.desc("chi"), "feature").limit(FEATURES - len(listed)).collect()
    names = list(dict.fromkeys([*listed, *(r["feature"] for r in best)]))
    stems = mined_stems(best, n_toxic, n_clean)
    voters = Voters(stems)
    index = {f: i for i, f in enumerate(names)}

    # the votes of all training rows, by pattern
    def vote(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Voters(stems)
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.votes(t) for t in decoded(batch.column(1))], pa.int64())], ["id", "votes"])

    voted = texts.mapInArrow(vote, "id long, votes long").join(given, "id", "left")
    patterns = stored(voted.groupBy("votes", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count("*").alias("n")), "patterns")
    label_model = fit_label_model(patterns, len(voters.names))

    def describe(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = Voters(stems), Memo(lambda w: tuple(index[f] for f in features_of(w.lower()) if f in index))
        for batch in source:
            out = []
            for label, text in zip(batch.column(0).to_pylist(), decoded(batch.column(1))):
                found, c = plain_words(text), Counter()
                for w in found:
                    c.update(memo[w])
                out.append((label, own.votes(text), list(c.keys()), [strength(n, len(found)) for n in c.values()]))
            label, votes, cols, values = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                pa.array(label, pa.int32()), pa.array(votes, pa.int64()), pa.array(cols, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                ["label", "votes", "cols", "values"])

    described = sample.mapInArrow(describe, "label int, votes long, cols array<int>, values array<double>").toPandas()
    if not n_toxic or not n_clean:
        return ToxicityModel(Classifier({w: 3.0 for w in listed}, -3.0), label_model, voters.names)
    target = label_model.posterior(unpacked(described["votes"].to_numpy(np.int64), len(voters.names)), described["label"].to_numpy())
    rows = [(dict(zip(c, v)), t) for c, v, t in zip(described["cols"], described["values"], target)]
    weights, bias = fit_classifier(rows, len(names))
    return ToxicityModel(Classifier({f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-4}, bias), label_model, voters.names)


def mined_stems(best: list, n_toxic: int, n_clean: int) -> list[str]:
    """Words and stems that labelled rows show to be all but peculiar to toxic ones; a stem stands for the words it begins."""
    found: list[str] = []
    for row in best:
        f, toxic, clean = row["feature"], row["toxic"], row["clean"]
        odds = (toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1))
        if toxic >= LEAST_DOCS and odds >= 10 and not any(f.startswith(g.rstrip("-")) for g in found if g.endswith("-")):
            found.append(f)
        if len(found) == STEM_VOTERS:
            break
    return found


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row, from its whole text alone; a null text is scored as an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model.classifier)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(sent.value.known)
        for batch in source:
            scores = [sent.value.score(t, memo) for t in decoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])
    return whole_texts(docs).select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).mapInArrow(run, "id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    A null text is scored as an empty one, bytes that are not UTF-8 as the
    replacement character.  Repeated rows score alike; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.classifier)
    at = docs.columns.index(text_col)
    memos: list[Memo] = []  # one in a worker

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo = memos[0] if memos else memos.append(Memo(sent.value.known)) or memos[0]
        texts = decoded(batch.column(at).cast(pa.binary()))
        return batch.filter(pa.array([sent.value.score(t, memo) < threshold for t in texts], pa.bool_()))
    return map_rows(docs, run)
