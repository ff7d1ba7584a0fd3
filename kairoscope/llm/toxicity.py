"""Toxicity: subword-bag embeddings averaged over a window of words into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams, `<` and `>` marking its ends; a window's vector is the mean of
its words' mean n-gram vectors; two logits follow from it by one linear layer. Embeddings and layer are trained
together, so a word never seen takes its vector from n-grams that other words taught. A document's score is the
largest over windows of WINDOW words (the last window takes the rest, so that none is short), which keeps one toxic
passage visible in a long text.

Defined results: null or empty text, or text without letters, has no window and gets the model's score of an empty
bag (its bias). Rows of labels with a null id or label, or without a text, teach nothing; an id labelled twice counts as toxic if any
of its labels is. Repeated rows give repeated results; whole texts are read, however long. With labels of one kind
only, or none, every score is that share (0 without labels).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kairoscope.llm.common import LETTERS, Words, declared, discard, map_slices, materialize, named, ngrams, offsets, sums

WINDOW = 192


class Model:
    """Embeddings E [buckets, dim], layer U [dim, 2], bias [2]."""

    BITS, LOW, HIGH, DIM = 18, 3, 6, 8

    def __init__(self, gaps: np.ndarray, bias: float):
        """gaps: E @ (U[:, 1] - U[:, 0]), all of E and U that a probability depends on; bias: the same of the bias."""
        self.gaps, self.bias = gaps, bias

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], weights: list[float] | None = None, steps: int = 120, rate: float = 0.05, decay: float = 1e-5, least: int = 5, evidence: float = 3.0, seed: int = 7) -> Model:
        """Full-batch Adam on cross-entropy. A window takes its document's label; documents weigh the same whatever their length."""
        y = np.asarray(labels, np.float64)
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(1 << cls.BITS, np.float32), 30.0 if len(y) and y[0] == 1 else -30.0)
        numbers: dict[str, int] = {}
        flat, edges, owner = [], [0], []
        for d, text in enumerate(texts):
            ws = LETTERS.findall(text.lower())
            own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int32, len(ws))
            flat.append(own)
            at = windows(len(ws))
            edges.extend((edges[-1] + at[1:]).tolist())
            owner.extend([d] * (len(at) - 1))
        word, edges, owner = np.concatenate(flat), np.asarray(edges), np.asarray(owner)
        of, bucket = ngrams(list(numbers), cls.LOW, cls.HIGH, cls.BITS)
        # n-grams whose documents do not differ by label only teach the training rows by heart
        held = np.zeros((2, 1 << cls.BITS))
        grams = offsets(np.bincount(of, minlength=len(numbers)))
        place = np.argsort(of, kind="stable")
        for own, label in zip(flat, labels):
            mine = np.unique(own)
            take = place[_ranges(grams[mine], grams[mine + 1])]
            held[int(label), np.unique(bucket[take])] += 1
        count = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)[:, None]
        share, both = held / count, held.sum(axis=0) / count.sum()
        apart = np.abs(share[1] - share[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / count).sum())
        common = (apart >= evidence) & (held.sum(axis=0) >= least)
        parts = 1.0 / np.maximum(1, np.bincount(of, minlength=len(numbers)))
        of, bucket = of[common[bucket]], bucket[common[bucket]]
        used, bucket = np.unique(bucket, return_inverse=True)
        sizes = np.diff(edges)
        row = np.repeat(np.arange(len(sizes)), sizes)
        weight = np.asarray(weights if weights is not None else np.ones(len(y)), np.float64)[owner] / np.bincount(owner, minlength=len(y))[owner]
        weight /= weight.sum()
        target = np.stack([1 - y[owner], y[owner]], axis=1)
        rng = np.random.default_rng(seed)
        params = [rng.normal(0, 0.3, (len(used), cls.DIM)), rng.normal(0, 0.3, (cls.DIM, 2)), np.zeros(2)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            emb, layer, bias = params
            # mean of means: n-grams to words, words to windows
            logits = np.empty((len(sizes), 2))
            flatgram = emb @ layer
            for c in range(2):
                per_word = np.bincount(of, flatgram[bucket, c], len(numbers)) * parts
                logits[:, c] = sums(per_word[word], edges) / np.maximum(1, sizes)
            logits = SCALE * logits + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            off = (p - target) * weight[:, None]
            pull = np.empty((len(used), 2))
            for c in range(2):
                per_word = np.bincount(word, (SCALE * off[:, c] / np.maximum(1, sizes))[row], len(numbers)) * parts
                pull[:, c] = np.bincount(bucket, per_word[of], len(used))
            grads = [pull @ layer.T + decay * emb, emb.T @ pull + decay * layer, off.sum(axis=0)]
            pace = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                params[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
        emb, layer, bias = params
        gaps = np.zeros(1 << cls.BITS, np.float32)
        gaps[used] = SCALE * (emb @ (layer[:, 1] - layer[:, 0]))
        return cls(gaps, float(bias[1] - bias[0]))

    def word_gaps(self, words: list[str]) -> np.ndarray:
        of, bucket = ngrams(words, self.LOW, self.HIGH, self.BITS)
        return (np.bincount(of, self.gaps[bucket], len(words)) / np.maximum(1, np.bincount(of, minlength=len(words))))[:, None]

    def scores(self, texts: list[str | None], table: Words) -> np.ndarray:
        """Probability of label 1 for each text: the softmax of its strongest window."""
        found = [LETTERS.findall((t or "").lower()) for t in texts]
        gaps = table.look_up([w for ws in found for w in ws])[:, 0].astype(np.float64)
        at = [windows(len(ws)) for ws in found]
        start = offsets([len(ws) for ws in found])
        edges = np.concatenate([s + a[:-1] for s, a in zip(start, at)] + [start[-1:]])
        logit = sums(gaps, edges) / np.maximum(1, np.diff(edges)) + self.bias
        top = np.maximum.reduceat(logit, offsets([len(a) - 1 for a in at])[:-1]) if len(texts) else logit[:0]
        return 1 / (1 + np.exp(-np.clip(top, -60, 60)))


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The integers of low[0]:high[0], low[1]:high[1] and so on."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


#: A mean over windows moves little: the layer sees it this many times as large, which speeds training up.
SCALE = 16.0


def windows(n: int) -> np.ndarray:
    """Edges of the windows of n words; at least one window, which is empty for no words."""
    count = max(1, n // WINDOW)
    return np.append(np.arange(count) * WINDOW, n)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", positives: int = 2000, negatives: int = 3000, bytes_each: int = 16 << 20, weigh: bool = True) -> Model:
    """Fit on a bounded sample of labelled rows that have a text: at most so many of each label, in the order of a hash
    of the id, and at most bytes_each bytes of their text (ids beyond that are left out whole, as are texts above an
    eighth of it, so that a few long ones do not make up the sample). Weights restore the labels' shares. Of several
    rows with one id the shortest text teaches."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y")).where(F.col("y").isin(0, 1))
    texts = docs.select(F.col(key), F.col(text).alias("text"), F.octet_length(text).alias("size")).where(F.col(key).isNotNull() & (F.col("size") <= bytes_each // 8))
    # labels meet sizes, not texts: the join moves two numbers a document
    known = materialize(known.join(texts.groupBy(key).agg(F.min("size").alias("size")), key), "labelled")
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64(F.lit("toxic-sample"), key)
    ids = [known.where(F.col("y") == y).orderBy(order, key).limit(n) for y, n in ((1, positives), (0, negatives))]
    total, used, chosen = {0: 0, 1: 0}, {0: 0, 1: 0}, {}
    for r in sorted(ids[0].unionByName(ids[1]).collect(), key=lambda r: _spread(r[key])):
        if total[r["y"]] + r["size"] <= bytes_each:
            total[r["y"]] += r["size"]
            used[r["y"]] += 1
            chosen[r[key]] = r["y"]
    discard(known)
    if not chosen:
        return Model.fit([], [])
    wanted = docs.sparkSession.createDataFrame([(k,) for k in chosen], StructType([known.schema[key]]))  # at most positives + negatives ids
    found = {r[key]: r["text"] for r in texts.join(F.broadcast(wanted), key).groupBy(key).agg(F.min_by("text", F.struct("size", "text")).alias("text")).collect()}
    return Model.fit([found[k] for k in chosen], list(chosen.values()), [share[y] / used[y] for y in chosen.values()] if weigh else None)


def _spread(key) -> int:
    return int.from_bytes(hashlib.blake2b(str(key).encode(), digest_size=8).digest(), "big")


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all if None) with score and predicted (1 from score 0.5)."""
    broadcast = docs.sparkSession.sparkContext.broadcast((model.gaps, model.bias))
    added = {"score": "double", "predicted": "int"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    docs = docs.select(*named(dict.fromkeys([*kept, text])))

    def make():
        known = Model(*broadcast.value)
        table = Words(known.word_gaps, 1)

        def rate(part: pa.Table) -> pa.Table:
            score = known.scores(part.column(text).to_pylist(), table)
            return part.select(kept).append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= 0.5).astype(np.int32)))

        return rate

    return map_slices(docs, make, declared(docs.select(*named(kept)), added), text)
