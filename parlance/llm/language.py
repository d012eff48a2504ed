"""Language ID by interpolated Kneser-Ney character models, one for each language.

A text's words are its runs of letters in lower case, each with a start and an end
mark.  A language's model holds every n-gram up to ``order`` that its sample shows,
in arrays sorted by hash: the discounted probability of the n-gram and the weight
that its context leaves to the next shorter one; the shortest interpolates with a
uniform share.  A text gets the language with the lowest cross-entropy a character
(end marks included), so length plays no part in the choice.

The models are fitted on a bounded sample of labelled rows: about ``per_language``
documents of each language, chosen by hash, of which a fifth calibrates.  From
these come a temperature for the score and, for each language, the cross-entropy
beyond which a text is rejected as none of the learned languages: above the 90 %
quantile of the calibration documents that the model assigns to it, so that single
rows and wrong labels don't move it.  A language with few of them gets its limit by
cross-validation on its own documents, or, where these go to other languages, the
highest limit of the others; none is without.  Everything else reads every document
whole.

A null text or one without letters is ``und`` with score 0, and rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._bytes import give_back

LETTERS = re.compile(r"[^\W\d_]+")
START, END = 1, 2
ALPHABET = 4096.0
STEP = np.uint64(0x9E3779B97F4A7C15)


def _flatten(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each as START word END, and where each begins."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint64)
    inside = np.ones(len(flat), bool)
    inside[first] = False
    inside[first + size - 1] = False
    flat[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat[first], flat[first + size - 1] = START, END
    return flat, first


def _grams(flat: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..order: (hash, hash of its context, usable) of the n-gram that ends at each character.

    The context is the (n - 1)-gram that ends one character before.  A word's START
    is a context only; an n-gram reaches back to START at most.
    """
    n = len(flat)
    begin = np.zeros(n, np.int64)
    begin[first] = first
    depth = np.arange(n) - np.maximum.accumulate(begin)
    out, context = [], np.zeros(n, np.uint64)
    for k in range(1, order + 1):
        whole = (context ^ (flat + np.uint64(k))) * STEP
        whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        whole ^= whole >> np.uint64(29)
        out.append((whole, context, (depth >= 1) & (depth >= k - 1)))
        context = np.concatenate([np.zeros(1, np.uint64), whole[:-1]])
    return out


class KneserNey:
    """Interpolated Kneser-Ney models of characters, one for each language, over shared sorted hash arrays.

    For each order: the n-grams' hashes, and for each language the discounted
    probability of the n-gram and the weight that it leaves as a context.
    """

    def __init__(self, counts: list[Counter], order: int = 5):
        self.order, self.languages = order, len(counts)
        single = [self._estimate(c, order) for c in counts]
        self.root = np.array([s[0] for s in single])
        self.keys, self.value, self.left = [], [], []
        for k in range(order):
            keys = np.unique(np.concatenate([x for s in single for x in (s[1][k][0], s[1][k][2])] or [np.zeros(0, np.uint64)]))
            value, left = np.zeros((len(keys), len(counts))), np.ones((len(keys), len(counts)))
            for i, (_, tables) in enumerate(single):
                key, v, context, weight = tables[k]
                value[np.searchsorted(keys, key), i] = v
                at = np.searchsorted(keys, context)
                here = at < len(keys)
                here[here] = keys[at[here]] == context[here]
                left[at[here], i] = weight[here]
            self.keys.append(keys)
            self.value.append(value)
            self.left.append(left)

    @staticmethod
    def _estimate(words: Counter, order: int):
        """The weight of the uniform share, and for each order (hash, probability, hash as context of the next order, weight)."""
        names = sorted(words)
        flat, first = _flatten(names)
        weight = np.repeat(np.array([words[w] for w in names], float), np.diff(np.append(first, len(flat))))
        grams = _grams(flat, first, order)
        found = []
        for k in range(order):
            whole, before, use = grams[k]
            key, at, inverse = np.unique(whole[use], return_index=True, return_inverse=True)
            if k == order - 1:
                count = np.bincount(inverse, weight[use], len(key))
            else:  # how many different characters stand before it; at a word's start there is none, so its frequency
                longer, _, longer_use = grams[k + 1]
                _, one = np.unique(longer[longer_use], return_index=True)
                count = np.bincount(np.searchsorted(key, whole[longer_use][one]), minlength=len(key)).astype(float)
                bare = np.bincount(inverse, weight[use] * ~longer_use[use], len(key))
                count = np.where(bare > 0, bare, count)
            context, which = np.unique(before[use][at], return_inverse=True)
            total, kinds = np.bincount(which, count, len(context)), np.bincount(which, minlength=len(context))
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            found.append((key, np.maximum(count - discount, 0) / total[which], context, np.minimum(discount * kinds / total, 1.0)))
        none = np.zeros(0, np.uint64)
        after = [*((c, w) for _, _, c, w in found[1:]), (none, np.zeros(0))]
        return found[0][3][0], [(key, v, c, w) for (key, v, _, _), (c, w) in zip(found, after, strict=True)]

    def log_probability(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log-probability of each word (its end mark included) in each language."""
        n = len(flat)
        p = np.full((n, self.languages), 1 / ALPHABET) * self.root
        place = np.full(n, -1)
        for k, (whole, _, use) in enumerate(_grams(flat, first, self.order)):
            at = np.flatnonzero(use) if k == 0 else np.flatnonzero(use & np.concatenate([[False], place[:-1] >= 0]))
            if k:
                p[at] *= self.left[k - 1][place[at - 1]]
            keys, now = self.keys[k], np.full(n, -1)
            # a word's start mark is a context though no n-gram ends in it
            ask = np.arange(n) if k == 0 else at
            if len(keys):
                i = np.minimum(np.searchsorted(keys, whole[ask]), len(keys) - 1)
                hit = keys[i] == whole[ask]
                now[ask[hit]] = i[hit]
                gain = ask[hit] if k else ask[hit & use[ask]]
                p[gain] += self.value[k][now[gain]]
            place = now
        p[first] = 1.0
        return np.add.reduceat(np.log(p), first, axis=0)


class Identifier:
    """The models of all languages with a cache of words' log-probabilities."""

    def __init__(self, sample: list[tuple[str, str]], order: int = 5, keep: int = 150_000):
        """sample: (language, text) in a fixed order; each fifth of a language's calibrates."""
        counts, held, seen = {}, [], Counter()
        for lang, text in sample:
            seen[lang] += 1
            if seen[lang] % 5 == 0:
                held.append((lang, text))
            else:
                counts.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        self.languages = sorted(lang for lang, words in counts.items() if words)
        self.model = KneserNey([counts[lang] for lang in self.languages], order)
        self.keep, self.temperature, self.limits = keep, 10.0, np.full(len(self.languages), np.inf)
        self._forget()
        self._calibrate(held)
        self._limit_rare(sample)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "known", "length")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.known, self.length = np.zeros((1 << 14, len(self.languages))), np.zeros(1 << 14)

    def _learn(self, words: list[str]) -> None:
        flat, first = _flatten(words)
        i, n = len(self.index), len(words)
        while i + n > len(self.length):
            self.known, self.length = np.concatenate([self.known, np.zeros_like(self.known)]), np.concatenate([self.length, np.zeros_like(self.length)])
        self.known[i : i + n] = self.model.log_probability(flat, first)
        self.length[i : i + n] = np.diff(np.append(first, len(flat))) - 1
        self.index.update(zip(words, range(i, i + n), strict=True))

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy a character of each text in each language; NaN without letters."""
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        size = np.array([len(w) for w in found], np.int64)
        out = np.full((len(texts), len(self.languages)), np.nan)
        if not size.any() or not self.languages:
            return out
        words = [w for ws in found for w in ws]
        if len(self.index) > self.keep:
            self._forget()
        at = list(map(self.index.get, words))
        if None in at:
            self._learn([w for w in dict.fromkeys(words) if w not in self.index])
            at = list(map(self.index.get, words))
        at = np.array(at)
        live = np.flatnonzero(size)
        edge = (np.cumsum(size) - size)[live]
        out[live] = -np.add.reduceat(self.known[at], edge, axis=0) / np.add.reduceat(self.length[at], edge)[:, None]
        return out

    def _calibrate(self, held: list[tuple[str, str]]) -> None:
        held = [(lang, text) for lang, text in held if lang in self.languages]
        e = self.entropies([text for _, text in held])
        use = ~np.isnan(e).any(1) if len(held) else np.zeros(0, bool)
        truth, e = np.array([self.languages.index(lang) for lang, _ in held], int)[use], e[use]
        if not len(truth):
            return
        best = (np.inf, self.temperature)
        for t in (2.0, 4.0, 8.0, 16.0, 32.0, 64.0):
            z = -t * (e - e.min(1, keepdims=True))
            loss = -np.mean((z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(len(e)), truth])
            best = min(best, (loss, t))
        self.temperature = best[1]
        for k in range(len(self.languages)):
            own = e[(truth == k) & (e.argmin(1) == k), k]
            if len(own) >= 5:
                self.limits[k] = self._limit(own)

    @staticmethod
    def _limit(own: np.ndarray) -> float:
        middle, high = np.quantile(own, [0.5, 0.9])
        return float(high + min(max(1.0, 3 * (high - middle)), 2.0))

    def _limit_rare(self, sample: list[tuple[str, str]]) -> None:
        """Limits of the languages without enough calibration documents."""
        pooled = max(self.limits[np.isfinite(self.limits)], default=None)
        for k in np.flatnonzero(np.isinf(self.limits)):
            texts = [text for lang, text in sample if lang == self.languages[k]]
            docs = [words for text in texts if (words := LETTERS.findall(text.lower()))]
            if len(docs) == 1:
                docs = [half for half in (docs[0][::2], docs[0][1::2]) if half]
            other = self.entropies([" ".join(words) for words in docs])
            other[:, k] = np.inf
            folds, own = min(5, len(docs)), np.full(len(docs), np.nan)
            for f in range(folds if folds > 1 else 0):
                model = KneserNey([Counter(w for i, words in enumerate(docs) if i % folds != f for w in words)], self.model.order)
                for i in range(f, len(docs), folds):
                    flat, first = _flatten(docs[i])
                    own[i] = -model.log_probability(flat, first).sum() / (len(flat) - len(first))
            mine = own[own <= other.min(1)]
            if len(mine) >= 2:
                self.limits[k] = self._limit(mine)
            elif pooled is not None:
                self.limits[k] = pooled
            else:
                self.limits[k] = self._limit(own) if folds > 1 else np.log(ALPHABET) / 2

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, cross-entropy and whether it is rejected, of each text."""
        out = []
        for e in (row for part in _parts(texts) for row in self.entropies(part)):
            if not len(e) or np.isnan(e[0]):
                out.append(("und", 0.0, None, True))
            else:
                k = int(e.argmin())
                out.append((self.languages[k], float(1 / np.exp(-self.temperature * (e - e[k])).sum()), float(e[k]), bool(e[k] > self.limits[k])))
        return out


def _parts(texts: list[str | None], chars: int = 1 << 19) -> Iterator[list[str | None]]:
    """Runs of texts of about so many characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(docs: DataFrame, per_language: int = 400, max_chars: int = 20_000, order: int = 5, most_languages: int = 1000) -> Identifier:
    """Fits on labelled rows (text, lang): about per_language of each language, of at most max_chars each.

    Rows are chosen by a hash of id and text, equal ones once; only the most_languages
    most frequent labels are learned.  Texts are filtered where they are read.
    """
    rows = docs.where("text is not null and lang is not null").where(F.length("text") <= max_chars)
    key = F.concat_ws(":", F.lit("lang"), F.coalesce(F.col("doc_id").cast("string"), F.hex(F.xxhash64("text"))))
    u = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(16**12)
    counts = rows.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(most_languages)
    chosen = rows.select("lang", "text", u.alias("_u")).join(F.broadcast(counts), "lang")  # most_languages rows
    table = chosen.where(F.col("_u") < per_language / F.col("_n")).select("lang", "text", "_u").distinct().toArrow()
    sample = sorted(zip(*(table.column(c).to_pylist() for c in ("lang", "_u", "text")), strict=True))
    return Identifier([(lang, text) for lang, _, text in sample], order)


def identify(docs: DataFrame, model: Identifier, keep: tuple = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score (0 to 1), cross_entropy and rejected, from the whole text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the sample's n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = held.value.predict(batch.column(len(keep)).to_pylist())
            cols = [pa.array(x, t) for x, t in zip(zip(*got, strict=True) if got else [[]] * 4, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *cols], [*keep, "lang_pred", "score", "cross_entropy", "rejected"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Identifier) -> DataFrame:
    """The rows, in all their columns, whose text the model does not reject."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not p[3] for p in held.value.predict(batch.column(at).to_pylist())], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
