"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Two models of the letters of words, one of toxic and one of ordinary documents, back
off to counts that both share: n-grams of up to ``shared`` characters are estimated
from both classes together, so that a rare expression that neither has seen is as
likely in one as in the other, and inflected or compounded forms of a toxic word are
near it.  A text is compared by its log-likelihoods in both, divided by the number of
characters: over the whole text, over its best word and over its best run of four
words, for a few toxic words in a long ordinary text move its mean by nothing.  A
logistic function of the three, fitted on documents that the models compared did not
see (cross-fitting), gives the score.

What is fitted comes from a bounded sample: at most ``per_class`` documents of each
label, of at most ``max_chars`` characters, chosen by hash; scoring reads whole texts.

Defined results: a text that is null, empty or without a letter has three zeros for its
features and so the same, low score.  A doc_id with several labels has its highest; null
labels and ids are no labels.  Without labelled documents of both classes there is
nothing to compare and each score is 0.  Equal texts have equal scores; repeated rows
and rows without doc_id keep their rows.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm._bytes import give_back
from parlance.llm.language import LETTERS, KneserNey, _flatten, _parts

RUN = 4
TOXIC, ORDINARY = 0, 1


class SharedBackoff(KneserNey):
    """Two Kneser-Ney models whose n-grams of up to ``shared`` characters come from the counts of both."""

    def __init__(self, toxic: Counter, ordinary: Counter, order: int = 6, shared: int = 2):
        self.order, self.languages = order, 2
        both = self._estimate(toxic + ordinary, order)
        own = [self._estimate(c, order) for c in (toxic, ordinary)]
        self.root = np.full(2, both[0])
        self.keys, self.value, self.left = [], [], []
        for k in range(order):
            # a context's weight belongs to the order that it leads to
            grams = [both[1][k][:2]] * 2 if k < shared else [m[1][k][:2] for m in own]
            contexts = [both[1][k][2:]] * 2 if k + 1 < shared else [m[1][k][2:] for m in own]
            keys = np.unique(np.concatenate([x[0] for x in (*grams, *contexts)]))
            value, left = np.zeros((len(keys), 2)), np.ones((len(keys), 2))
            for i, ((key, v), (context, weight)) in enumerate(zip(grams, contexts, strict=True)):
                value[np.searchsorted(keys, key), i] = v
                left[np.searchsorted(keys, context), i] = weight
            self.keys.append(keys)
            self.value.append(value)
            self.left.append(left)


class Comparer:
    """Features of texts by one pair of models; the words seen lately are kept."""

    def __init__(self, model: SharedBackoff, keep: int = 150_000):
        self.model, self.keep = model, keep
        self._forget()

    def __getstate__(self):
        return {"model": self.model, "keep": self.keep}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.known = np.zeros((2, 1 << 14))

    def _learn(self, words: list[str]) -> None:
        flat, first = _flatten(words)
        p = self.model.log_probability(flat, first)
        at = len(self.index)
        while at + len(words) > self.known.shape[1]:
            self.known = np.concatenate([self.known, np.zeros_like(self.known)], axis=1)
        self.known[0, at : at + len(words)] = p[:, TOXIC] - p[:, ORDINARY]
        self.known[1, at : at + len(words)] = np.diff(np.append(first, len(flat))) - 1
        self.index.update(zip(words, range(at, at + len(words)), strict=True))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Log-likelihood ratio a character: of the whole text, of its best word, of its best run of words (all, if it has fewer)."""
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        size = np.array([len(w) for w in found], np.int64)
        out = np.zeros((len(texts), 3))
        if not size.any():
            return out
        words = [w for ws in found for w in ws]
        if len(self.index) > self.keep:
            self._forget()
        at = list(map(self.index.get, words))
        if None in at:
            self._learn([w for w in dict.fromkeys(words) if w not in self.index])
            at = list(map(self.index.get, words))
        ratio, chars = (np.concatenate([[0.0], np.cumsum(x)]) for x in self.known[:, at])
        live = np.flatnonzero(size)
        end = np.cumsum(size)[live]
        start = end - size[live]
        out[live, 0] = (ratio[end] - ratio[start]) / (chars[end] - chars[start])
        for column, run in ((1, 1), (2, RUN)):
            until = np.minimum(np.arange(len(words)) + run, np.repeat(end, size[live]))
            begin = np.arange(len(words))
            short = until - begin < np.minimum(run, np.repeat(size[live], size[live]))
            value = (ratio[until] - ratio[begin]) / (chars[until] - chars[begin])
            value[short] = -np.inf
            out[live, column] = np.maximum.reduceat(value, start)
        return out


class Scorer:
    """The models, and the logistic function of their features."""

    def __init__(self, sample: list[tuple[int, str]], order: int = 6, shared: int = 2, folds: int = 4):
        """sample: (label, text) in a fixed order; each document is judged by models of the other folds."""
        labels = np.array([label for label, _ in sample], float)
        self.comparer = None
        if len(set(labels.tolist())) < 2:
            return
        counts = [[Counter() for _ in range(folds)] for _ in range(2)]
        for i, (label, text) in enumerate(sample):
            counts[TOXIC if label else ORDINARY][i % folds].update(LETTERS.findall(text.lower()))
        features = np.zeros((len(sample), 3))
        for f in range(folds):
            rest = [sum((c for g, c in enumerate(own) if g != f), Counter()) for own in counts]
            if all(rest):
                judge = Comparer(SharedBackoff(rest[TOXIC], rest[ORDINARY], order, shared))
                features[f::folds] = judge.features([text for _, text in sample[f::folds]])
        self.weights = _logistic(features, labels)
        whole = [sum(own, Counter()) for own in counts]
        if all(whole):
            self.comparer = Comparer(SharedBackoff(whole[TOXIC], whole[ORDINARY], order, shared))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Between 0 and 1 for each text."""
        if self.comparer is None:
            return np.zeros(len(texts))
        found = [self.comparer.features(part) for part in _parts(texts)]
        z = np.concatenate(found) @ self.weights[1:] + self.weights[0] if found else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Bias and weights by Newton's steps, with a small ridge over standardised features so that separable data end as well."""
    middle, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.hstack([np.ones((len(x), 1)), (x - middle) / spread])
    w = np.zeros(a.shape[1])
    keep = np.diag([0.0, *[ridge * len(x)] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + keep + 1e-9 * np.eye(len(w)), a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[1:] / spread
    return np.concatenate([[w[0] - middle @ slope], slope])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 1500, max_chars: int = 20_000, **options) -> Scorer:
    """Fits on labelled documents (doc_id, text) and (doc_id, toxic).

    usable: of the ids that may be learned from.  At most per_class documents of each
    label come to the driver: ids are thinned by hash, joined where documents are read,
    and ranked by a hash of id and text, so that rows sharing an id are bounded as well.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = known.groupBy("toxic").agg(F.count("*").alias("n")).collect()  # a row for each label
    hashed = lambda *columns: F.xxhash64(F.lit("toxicity"), *columns) / F.lit(float(2**64)) + F.lit(0.5)
    bound = F.lit(0.0)
    for row in share:
        bound = F.when(F.col("toxic") == row.toxic, F.lit(2.0 * per_class / row.n)).otherwise(bound)
    thinned = known.where(hashed("doc_id") < bound)
    # about twice per_class ids of each label
    ids = thinned.withColumn("_rank", F.row_number().over(Window.partitionBy("toxic").orderBy(hashed("doc_id"), "doc_id"))).where(F.col("_rank") <= 2 * per_class).select("doc_id", "toxic")
    rows = docs.where(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic", "doc_id", "text").distinct()
    order = Window.partitionBy("toxic").orderBy(hashed("doc_id", "text"), "doc_id", "text")
    chosen = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_class).select("toxic", "_rank", "text").toArrow()
    sample = sorted(zip(*(chosen.column(c).to_pylist() for c in ("_rank", "toxic", "text")), strict=True))
    return Scorer([(label, text) for _, label, text in sample], **options)


def score(docs: DataFrame, scorer: Scorer, keep: tuple = ("doc_id",)) -> DataFrame:
    """The kept columns and score, from the whole text alone."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded: the sample's n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = held.value.scores(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(got, pa.float64())], [*keep, "score"])
        give_back()

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, score double")
