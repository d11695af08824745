"""A toxicity classifier with counterfactual regularisation.

A logistic model on the words of a text and their beginnings. Features are chosen by counts
over all labelled rows, the weights fitted on a bounded sample of them. For each sentence of
the sample that names a group, copies are made with the name swapped for every other name of
its kind; a difference between the scores of a sentence and its copies is penalised, so that
the name of a group alone does not move a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._common import release, steps, stored

#: Labelled rows that the weights are fitted on at most, features at most, and rows that a feature needs.
SAMPLE, FEATURES, SUPPORT = 20_000, 4096, 3
#: Lengths of the beginnings of words that are features besides the word.
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?;\n]+")

# Names of groups that are swapped for each other, row by row.
GROUPS = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indian"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual", "queer"),
    ("disabled", "blind", "deaf", "old", "young", "immigrant", "refugee", "foreigner", "immigrants", "refugees", "foreigners"),
)
SWAPS = {w: tuple(x for x in g if x != w) for g in GROUPS for w in g}


def word_features(word: str) -> tuple[str, ...]:
    """The word, and its beginnings marked with ``*``."""
    return (word, *(word[:n] + "*" for n in STEMS if len(word) >= n))


#: Bytes of ASCII text in lower case, with a space for what is no letter.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))


def text_words(text: str) -> set[str]:
    """The words of a text in lower case: runs of letters."""
    return set(text.encode().translate(_LETTERS).decode().split()) if text.isascii() else set(_WORD.findall(text.lower()))


def text_features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


class Known(dict):
    """What ``make`` gives for words, made once for each word while there is room."""

    def __init__(self, make: Callable[[str], tuple[str, ...]], room: int = 500_000):
        self.make, self.room = make, room

    def __missing__(self, word: str) -> tuple[str, ...]:
        made = self.make(word)
        if len(self) < self.room:
            self[word] = made
        return made

    def of(self, words: set[str]) -> set[str]:
        """All that the words give together."""
        return set().union(*map(self.__getitem__, words))


@dataclass
class Model:
    """Weights of features; a text's score is the logistic function of their sum over the distinct features it has."""

    weights: dict[str, float]
    bias: float

    def known(self) -> Known:
        """The features with a weight that words have."""
        return Known(lambda w: tuple(f for f in word_features(w) if f in self.weights))

    def scores(self, texts: list[str], known: Known | None = None) -> np.ndarray:
        known = self.known() if known is None else known
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            hits: set[str] = set()
            for w in text_words(text):
                if found := known[w]:  # most words have none
                    hits.update(found)
            out[i] = self.bias + sum(self.weights[f] for f in sorted(hits))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", most: int | None = SAMPLE) -> DataFrame:
    """(text, label, turn) of labelled rows that are not held out: at most ``most``, those with the smallest hashes (turn) of key and text.

    Rows with a null key or label teach nothing; of conflicting labels the larger counts. Labels
    grow with the corpus, so they are never broadcast: texts and labels meet by key at every size.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(F.max("toxic").cast("int").alias("label"))
    texts = docs.where(~held_out(key)).select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # A row for each key on the right: texts are not sorted, and a hot key's texts are split by adaptive execution.
    rows = texts.join(known.hint("shuffle_hash"), F.col("_id") == F.col("_key")).select("text", "label", F.xxhash64("_id", "text").alias("turn"))
    return rows if most is None else rows.orderBy("turn", "label", "text").limit(most)


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, n0, n1): rows of each label with the feature, summed in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        known = Known(word_features)

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in seen)], ["feature", "n0", "n1"])
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in steps(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(known.of(text_words(text)))
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield flush()
        yield flush()

    return rows.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def choose(counts: DataFrame, totals: tuple[int, int], *, most: int = FEATURES, support: int = SUPPORT) -> list[str]:
    """The features whose shares among the labels differ the most in standard errors, at least 3."""
    n0, n1 = max(totals[0], 1), max(totals[1], 1)
    share = (F.col("n0") + F.col("n1") + 1) / F.lit(float(n0 + n1 + 2))
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(share * (1 - share) * F.lit(1 / n0 + 1 / n1))
    found = counts.where(F.col("n0") + F.col("n1") >= support).withColumn("z", z).where("z >= 3").orderBy(F.desc("z"), "feature").limit(most)
    return sorted(r.feature for r in found.select("feature").collect())


def counterfactuals(text: str) -> Iterator[tuple[set[str], set[str]]]:
    """(words, words with one name swapped) for each name of a group in each sentence and each other name of its kind."""
    for sentence in _SENTENCE_END.split(text):
        words = text_words(sentence)
        for w in sorted(words & SWAPS.keys()):
            for other in SWAPS[w]:
                yield words, words - {w} | {other}


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = SAMPLE, fairness: float = 1.0, ridge: float = 0.1, rounds: int = 300) -> Model:
    """Fits a model on the labelled rows that are not held out: features by all of them, weights by at most ``most``.

    Minimises the mean logistic loss, plus ``ridge`` / rows times the squared weights, plus
    ``fairness`` times the mean squared difference between the scores (before the logistic
    function) of sentences and their counterfactual copies. With no labelled rows, or
    rows of one label only, every text gets the (smoothed) share of that label.
    """
    rows = stored(training_rows(docs, labels, key=key, text=text, most=None))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    bias = float(np.log((n1 + 0.5) / (n0 + 0.5))) if n0 + n1 else float(np.log(0.05))
    if not n0 or not n1:
        return Model({}, bias)
    release(docs.sparkSession)  # the shuffled texts, before features are shuffled
    names = choose(feature_counts(rows), (n0, n1))
    # A group's name and its beginnings take part, so that the penalty can act on them.
    names = sorted({*names, *(f for w in SWAPS for f in word_features(w))})
    index = {f: i for i, f in enumerate(names)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features of a text, and how often its swaps lose (1, 2, ...) and gain (-1, -2, ...) which ones."""
        known = Known(lambda w: tuple(f for f in word_features(w) if f in index))
        for batch in steps(batches):
            own, swapped, times = [], [], []
            for t in batch.column(0).to_pylist():
                own.append(sorted(index[f] for f in known.of(text_words(t))))
                swaps: Counter = Counter()
                for was, now in counterfactuals(t):
                    was, now = text_features(was), text_features(now)
                    swaps[(*sorted(index[f] + 1 for f in was - now if f in index), *sorted(-index[f] - 1 for f in now - was if f in index))] += 1
                swapped.append(list(map(list, swaps)))
                times.append(list(swaps.values()))
            kinds = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(c, k) for c, k in zip((own, swapped, times), kinds, strict=True))], ["label", "turn", "own", "swapped", "times"])

    # At most ``most`` rows, however often keys repeat, each with the chosen features only.
    cut = rows.select("turn").orderBy("turn").limit(most).agg(F.max("turn")).first()[0]
    made = rows.where(F.col("turn") <= cut).select("text", "label", "turn").mapInArrow(vectors, "label int, turn long, own array<int>, swapped array<array<int>>, times array<long>")
    found = made.orderBy("turn", "label", "own").limit(most).toArrow().to_pylist()
    found.sort(key=lambda r: (r["own"], r["label"], r["turn"]))
    y = np.array([r["label"] for r in found], float)
    at = np.concatenate([np.array(r["own"], int) for r in found])
    of = np.repeat(np.arange(len(found)), [len(r["own"]) for r in found])
    often: Counter = Counter()
    for r in found:
        for p, n in zip(r["swapped"], r["times"], strict=True):
            often[tuple(p)] += n
    pairs = sorted(often)
    share = np.array([often[p] for p in pairs], float) / max(1, sum(often.values()))
    signed = np.array([f for p in pairs for f in p], int)
    p_at, p_sign, p_of = np.abs(signed) - 1, np.sign(signed).astype(float), np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    w, b, m = np.zeros(len(names)), bias, len(found)

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        s = b + np.bincount(of, w[at], m)
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        value = float(np.mean(np.logaddexp(0, s) - y * s)) + ridge / m * float(w @ w) / 2
        g = np.bincount(at, ((p - y) / m)[of], len(names)) + ridge / m * w
        if len(pairs):
            apart = np.bincount(p_of, p_sign * w[p_at], len(pairs))
            value += fairness * float(share @ apart**2)
            g += np.bincount(p_at, 2 * fairness * (share * apart)[p_of] * p_sign, len(names))
        return value, g, float((p - y).mean())

    # Accelerated gradient steps, each halved until the loss falls as the gradient says.
    v, vb, step, momentum = w.copy(), b, 1.0, 1.0
    for _ in range(rounds):
        value, g, gb = loss(v, vb)
        size = float(g @ g) + gb * gb
        if size < 1e-12:
            break
        step *= 1.5
        while loss(v - step * g, vb - step * gb)[0] > value - step / 2 * size and step > 1e-9:
            step /= 2
        w2, b2 = v - step * g, vb - step * gb
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, vb = w2 + (momentum - 1) / after * (w2 - w), b2 + (momentum - 1) / after * (b2 - b)
        w, b, momentum = w2, b2, after
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, float(b))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row, by its whole text alone. Null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights and the groups' names at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.known()
        for batch in steps(batches):
            values = shared.value.scores([t or "" for t in batch.column(1).to_pylist()], known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.known()
        for batch in steps(batches, text):
            values = shared.value.scores([t or "" for t in batch.column(batch.schema.names.index(text)).to_pylist()], known)
            yield batch.filter(pa.array(values < threshold))

    return docs.mapInArrow(run, docs.schema)
