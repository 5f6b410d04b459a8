"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a window; windows overlap by half. A document's score is that of its worst window.
WINDOW = 24
#: Labelled documents per label that a model is fitted on, characters of each, and windows of each that is clean and
#: that is toxic, drawn at random. These bound the fit alone; scoring takes whole texts.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, SAMPLE_WINDOWS, TOXIC_WINDOWS = 1200, 20_000, 16, 64
#: Longer runs without white space are scored and learned in pieces of so many characters; pieces overlap by so many,
#: so that no n-gram falls between two of them.
PIECE, OVERLAP = 40, 4
#: Distinct words whose logit a Python process remembers.
CACHE_WORDS = 400_000

EDGE = " \t\r\n.,;:!?#*$%&|<>()[]{}\"'-_=+~"


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their ends, in pieces where long; of a word that follows itself, one stays."""
    words = [w for x in (text or "").lower().split() if (w := x.strip(EDGE))]
    once = [w for w, before in zip(words, [None, *words], strict=False) if w != before]
    return [w[i : i + PIECE] for w in once for i in range(0, max(1, len(w) - OVERLAP), PIECE - OVERLAP)]


def grams(word: str, buckets: int) -> list[int]:
    """Buckets of the word itself and of its character n-grams of 3 to 5, its ends marked."""
    w = f"<{word}>"
    found = {w, *(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))}
    return sorted({zlib.crc32(g.encode()) % buckets for g in found})


@dataclass
class Model:
    """Embeddings of n-gram buckets and the softmax over two classes (clean, toxic)."""

    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.embedding)

    def gram_logits(self) -> np.ndarray:
        """What a bucket adds to the difference of the classes' logits: the model is linear in its bag."""
        return (self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)


def _spread(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    out = np.zeros((n, values.shape[1]), np.float32)
    for j in range(values.shape[1]):
        out[:, j] = np.bincount(index, values[:, j], n)
    return out


def fit(texts: list[str], labels: list[int], buckets: int = 1 << 15, dim: int = 6, epochs: int = 60, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Model:
    """Train embeddings and softmax together, by Adam on the cross-entropy of documents.

    A document is a bag of windows; its loss is taken at the window that scores highest at the time (the windows of a
    toxic document need not all be toxic, those of a clean one all are clean). Without both labels the model is neutral.
    """
    rng = np.random.default_rng(seed)
    e = (rng.standard_normal((buckets, dim)) * 0.1).astype(np.float32)
    u = (rng.standard_normal((dim, 2)) * 0.1).astype(np.float32)
    b = np.zeros(2, np.float32)
    y = np.asarray(labels, np.int64)
    bags: list[np.ndarray] = []
    owner: list[int] = []
    number: dict[str, int] = {}
    for i, t in enumerate(texts):
        w = np.array([number.setdefault(x, len(number)) for x in words_of(t)], np.int32)
        starts = list(range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2))
        most = TOXIC_WINDOWS if y[i] else SAMPLE_WINDOWS
        if len(starts) > most:
            starts = sorted(rng.choice(starts, most, replace=False).tolist())
        for s in starts:
            if len(w[s : s + WINDOW]):
                bags.append(w[s : s + WINDOW])
                owner.append(i)
    if not bags or y.min() == y.max():
        return Model(np.zeros((1, dim), np.float32), u, b)
    bag_word = np.concatenate(bags)
    bag_of = np.repeat(np.arange(len(bags)), list(map(len, bags)))
    bag_size = np.bincount(bag_of, minlength=len(bags)).astype(np.float32)[:, None]
    lists = [grams(w, buckets) for w in number]
    gram = np.array([g for x in lists for g in x], np.int32)
    gram_start = np.cumsum([0, *map(len, lists)])[:-1]
    word_size = np.array(list(map(len, lists)), np.float32)[:, None]
    word_of = np.repeat(np.arange(len(lists)), list(map(len, lists)))
    bag_start = np.cumsum([0, *map(len, bags)])[:-1]
    own = np.array(owner)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, u, b)]
    for step in range(1, epochs + 1):
        words = np.add.reduceat(e[gram], gram_start) / word_size
        means = np.add.reduceat(words[bag_word], bag_start) / bag_size
        z = means @ u + b
        p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))
        order = np.lexsort((-p, own))
        first = order[np.r_[True, np.diff(own[order]) > 0]]
        some = first
        t = y[own[some]]
        g = np.zeros((len(bags), 2), np.float32)
        delta = (p[some] - t) / len(some)
        g[some, 1], g[some, 0] = delta, -delta
        live = np.flatnonzero(g[:, 1])
        grad_u, grad_b = means[live].T @ g[live], g.sum(axis=0)
        grad_mean = (g @ u.T) / bag_size
        used = np.isin(bag_of, live)
        grad_word = _spread(grad_mean[bag_of[used]], bag_word[used], len(lists)) / word_size
        hit = np.isin(word_of, np.unique(bag_word[used]))
        grad_e = _spread(grad_word[word_of[hit]], gram[hit], buckets) + decay * e
        for (m, v), q, dq in zip(state, (e, u, b), (grad_e, grad_u, grad_b), strict=True):
            m += 0.1 * (dq - m)
            v += 0.01 * (dq * dq - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(e, u, b)


class Scorer:
    def __init__(self, gram_logits: np.ndarray, bias: float):
        self.logits, self.bias, self.cache = gram_logits, bias, {}

    def word(self, w: str) -> float:
        x = self.logits[grams(w, len(self.logits))].mean()
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[w] = x
        return x

    def score(self, text: str | None) -> float:
        """Probability of the toxic class in the worst window; without words, that of an empty bag."""
        get = self.cache.get
        x = np.array([y if (y := get(w)) is not None else self.word(w) for w in words_of(text)])
        if not len(x):
            best = 0.0
        elif len(x) <= WINDOW:
            best = x.mean()
        else:
            sums = np.concatenate([[0.0], np.cumsum(x)])
            best = (sums[WINDOW:] - sums[:-WINDOW]).max() / WINDOW
        return float(1 / (1 + np.exp(-np.clip(best + self.bias, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, text: str = "text", key: str = "doc_id", label: str = "toxic", documents: int = SAMPLE_DOCUMENTS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample: the `documents` toxic and twice as many clean ones of least hash
    among the labelled and learnable documents, `chars` characters of each.

    Labels that are null or neither 0 nor 1 are left out, as are documents without text. Rows that repeat a key, a text
    and a label count once. Only keys and hashes meet the labels; texts are read again for the sample alone, whose keys
    (3 * documents at most) are broadcast.
    """
    tags = labels.select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    rows = docs.filter(learnable & F.col(text).isNotNull()).select(F.col(key).alias("label_key"), F.xxhash64(text).alias("h"), F.substring(text, 1, chars).alias("t"))
    tagged = rows.select("label_key", "h").join(tags, "label_key").distinct()
    least = [tagged.filter(F.col("label") == value).orderBy("h", "label_key").limit(n) for value, n in ((0, 2 * documents), (1, documents))]
    sample = rows.join(F.broadcast(least[0].union(least[1])), ["label_key", "h"]).dropDuplicates(["label_key", "h", "label"])
    picked = sample.orderBy("label", "h", "label_key").select("t", "label").limit(3 * documents).collect()
    return fit([r.t for r in picked], [r.label for r in picked])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (1 if score >= 0.5) added; columns of these names are replaced.

    Whole texts are scored; a null or empty text has the score of no words. Repeated rows stay.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*keep)
    at = keep.index(text)
    logits, bias = model.gram_logits(), float(model.bias[1] - model.bias[0])
    known: dict[str, Scorer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = known.setdefault("scorer", Scorer(logits, bias))
        for batch in batches:
            s = np.array([scorer.score(t.as_py()) for t in batch.column(at)], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")
