"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, trained by distributed gradient updates.

P(word | context) = P(class | context) P(word | class, context). The commonest words fill classes of WIDE words each, by
rank; the end of a text is one of them. All other words fall into TAILS classes by their last two bytes. The class's
softmax has the features (word before), (both words before) and, skipping one, (word before that); within a class of
common words so have the first and the last. Features are hashed into SHARED and OWN rows of weights; a word that is not
in a class of common words counts in a feature by its last three bytes. Within a tail class a word has its add-one
frequency, from counts of every word of the training texts, beside one place for all unknown words of the class; so the
probabilities sum to one over all words and TAILS unknowns. Without weights the model is that of the counts; weights are
learned in ROUNDS, each over its share of the training texts (by hash of the text; together they are all of them): tasks
send the gradient of their texts in blocks of rows, which are added up by shuffles, and the weights move by it, scaled
by the expected counts (the Hessian's diagonal) and bounded. Model and gradient have a fixed size whatever the corpus.

Scores are computed in sparse batches: the rows of a token's features are taken and added, STEP tokens at a time. Counts
of the COMMON commonest words go to every task (a bounded table); rarer words of a text meet their counts in a join on
the word.

Defined results: null and empty texts are an end and nothing else. Repeated rows and equal texts have equal scores up to
the order of sums of doubles. Without training texts nothing is known: the base score is 0, the model knows its tail
classes only. A text is held whole by one task, cut into STEP tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.common import declared, map_slices, materialize, named, offsets
from kairoscope.llm.simhash import _LOWER

#: The token after the last word: no word is empty.
END = b""
#: Classes of common words, tail classes, words of a class.
HEADS, TAILS, WIDE = 24, 8, 32
CLASSES = HEADS + TAILS  # as many as WIDE: rows of both tables have one length
#: Rows of weights of the classes' softmax and of those within classes, as powers of two; blocks in which gradients travel.
SHARED, OWN, BLOCKS = 15, 13, 1024
#: Words whose counts go to every task, and bytes of the longest of them.
COMMON, LONGEST = 1 << 17, 64
ROUNDS, RATE, PRIOR, BOUND = 3, 0.5, 2.0, 2.0
_FEATURES = 3
#: Tokens of a task in training: each sends a gradient of a fixed size, so that fewer are not worth a task.
TASK_TOKENS = 4_000_000
#: Tokens worked on at a time.
STEP = 8192
#: Different words, and characters of text, that a task counts before it sends its counts on.
MOST_WORDS, MOST_CHARS = 400_000, 64 << 20


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode().translate(_LOWER).split()  # at the six ASCII white spaces
    out.append(END)
    return out


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all tokens of docs; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0
        for batch in batches:
            for value in batch.column(0):
                text_ = value.as_py()
                held.update(tokens(text_))
                size += len(text_ or "")
                if len(held) > MOST_WORDS or size > MOST_CHARS:
                    yield _counted(held)
                    held.clear()
                    size = 0
        yield _counted(held)

    return docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter[bytes]) -> pa.RecordBatch:
    words = pa.array(held.keys(), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])


def tail_class(word: bytes) -> int:
    return HEADS + zlib.crc32(word[-2:]) % TAILS


class Model:
    """What every task gets: counts of common words, sums of the classes, weights. All of fixed size at most."""

    def __init__(self, common: list[tuple[bytes, int]], tails: dict[int, tuple[int, int]]):
        """common: words and counts, the commonest first; tails: number of tokens and of words of each tail class, common words included."""
        head = [(w, n) for w, n in common if w == END] + [(w, n) for w, n in common if w != END][: HEADS * WIDE - 1]
        self.counts = dict(common)
        self.place = {w: divmod(k, WIDE) for k, (w, _) in enumerate(sorted(head, key=lambda x: (-x[1], x[0])))}
        sums = {c: list(tails.get(c, (0, 0))) for c in range(HEADS, CLASSES)}
        self.tokens, self.words = sum(n for n, _ in sums.values()), sum(v for _, v in sums.values())
        inner = np.zeros((HEADS, WIDE))
        for w, (c, s) in self.place.items():
            inner[c, s] = self.counts[w] + 1
            sums[tail_class(w)][0] -= self.counts[w]
            sums[tail_class(w)][1] -= 1
        tail = np.array([n + v + 1 for n, v in sums.values()], np.float64)
        mass = np.concatenate([inner.sum(axis=1), tail])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.prior = mass / mass.sum()
            self.bias = np.maximum(np.log(self.prior), -80).astype(np.float32)
            share = np.nan_to_num(inner / inner.sum(axis=1, keepdims=True))
            self.inner_bias = np.maximum(np.log(share), -80).astype(np.float32)
        self.inner_prior = (share * self.prior[:HEADS, None]).sum(axis=0) / max(self.prior[:HEADS].sum(), 1e-300)
        self.tail_log = np.concatenate([np.zeros(HEADS), np.log10(tail)])
        self.shared, self.own = np.zeros((1 << SHARED, CLASSES), np.float32), np.zeros((1 << OWN, WIDE), np.float32)

    def __setstate__(self, state: dict) -> None:
        """Arrays read back have dtypes of their own, for which numpy's quick path of add.at is closed: 25 times as slow."""
        self.__dict__ = {k: v.astype(v.dtype.type) if isinstance(v, np.ndarray) else v for k, v in state.items()}

    def moved(self, gradient: np.ndarray) -> None:
        """One update: gradient [rows, WIDE + 1] of both tables, the last column how often a row was active."""
        for weights, prior, part in ((self.shared, self.prior, gradient[: 1 << SHARED]), (self.own, self.inner_prior, gradient[1 << SHARED :])):
            width = weights.shape[1]
            step = part[:, :width] / (part[:, -1:] * prior + PRIOR)
            weights += (RATE * np.clip(step, -BOUND, BOUND)).astype(np.float32)


class Words:
    """Numbers of words with what is known of each, while the word is held: place of its class, key in features, count."""

    def __init__(self, model: Model, most: int = 400_000, most_bytes: int = 16 << 20):
        self.model, self.most, self.most_bytes = model, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__  # a new word's number is how many there were
        self.known, self.bytes = np.zeros((4096, 4), np.int64), 0

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """[tokens, 4]: class, place in it (-1 in tail classes), key, count (-1 for a word that is not common)."""
        if len(self.numbers) > self.most or self.bytes > self.most_bytes:
            self.clear()
        numbers, before = self.numbers, len(self.numbers)
        got = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        if (n := len(numbers)) > before:
            if n > len(self.known):
                self.known = np.concatenate([self.known, np.zeros((max(n, 2 * len(self.known)) - len(self.known), 4), np.int64)])
            new = list(islice(numbers, before, None))
            self.bytes += sum(map(len, new))
            rows = self.known[before:n]
            each = lambda f, *x: np.fromiter(map(f, *x), np.int64, len(new))
            rows[:, 0] = HEADS + each(zlib.crc32, [w[-2:] for w in new]) % TAILS
            rows[:, 1] = -1
            rows[:, 2] = each(zlib.crc32, [w[-3:] for w in new], repeat(1))
            rows[:, 3] = each(self.model.counts.get, new, repeat(-1))
            for w in filter(self.model.place.__contains__, new):
                rows[numbers[w] - before, :3] = *self.model.place[w], zlib.crc32(w)
        return self.known[got]


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _row(bits: int, salt: int, *keys: np.ndarray) -> np.ndarray:
    mixed = np.full(len(keys[0]), salt, np.uint64)
    for k, odd in zip(keys, _ODD):
        mixed = (mixed ^ k.astype(np.uint64)) * odd
        mixed ^= mixed >> np.uint64(29)
    return ((mixed * _ODD[3]) >> np.uint64(64 - bits)).astype(np.int64)


def contexts(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the word before and of that before it; 0 where a text has none. first: whether a token begins its text."""
    one = np.zeros_like(key)
    one[1:] = key[:-1]
    one[first] = 0
    two = np.zeros_like(key)
    two[2:] = key[:-2]
    two[first] = 0
    two[1:][first[:-1]] = 0
    return one, two


def _scores(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Logits of a batch of tokens by the rows of their features. The largest that weights can add is _FEATURES * ROUNDS
    * RATE * BOUND = 9, so their exponentials need no shift."""
    z = bias + np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0)
    return z


def batches_of(model: Model, known: np.ndarray, first: np.ndarray):
    """For each STEP tokens: (their range; of both softmaxes: rows of features, target, logits; which tokens the second has)."""
    one, two = contexts(known[:, 2], first)
    for a in range(0, len(known), STEP):
        b = min(a + STEP, len(known))
        x, y, c = one[a:b], two[a:b], known[a:b, 0]
        rows = [_row(SHARED, 1, x), _row(SHARED, 2, x, y), _row(SHARED, 3, y)]
        outer = rows, c, _scores(model.bias, model.shared, rows)
        head = np.flatnonzero(c < HEADS)
        rows = [_row(OWN, 4, x[head], c[head]), _row(OWN, 5, y[head], c[head])]
        inner = rows, known[a:b, 1][head], _scores(np.take(model.inner_bias, c[head], axis=0), model.own, rows)
        yield slice(a, b), outer, inner, head


def _texts(part: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(what is known of each token, where texts begin and end, the tokens)."""
    found = [tokens(t) for t in part]
    flat = list(chain.from_iterable(found))
    return words.look_up(flat), offsets([len(ws) for ws in found]), flat


def _first(edges: np.ndarray) -> np.ndarray:
    first = np.zeros(edges[-1], bool)
    first[edges[:-1]] = True
    return first


def add_gradient(model: Model, known: np.ndarray, edges: np.ndarray, total: np.ndarray) -> None:
    """Add the gradient of the log-likelihood of a batch of texts to total [rows of both tables, WIDE + 1]."""
    flat, wide = total.reshape(-1), np.arange(WIDE)
    for _, outer, inner, _ in batches_of(model, known, _first(edges)):
        for (rows, target, z), base in ((outer, 0), (inner, 1 << SHARED)):
            p = np.exp(z, out=z)
            p *= (-1 / np.einsum("ij->i", p))[:, None]
            p[np.arange(len(p)), target] += 1
            for r in rows:
                at = (r + base) * (WIDE + 1)
                np.add.at(flat, (at[:, None] + wide).reshape(-1), p.reshape(-1))
                np.add.at(flat, at + WIDE, np.float32(1))


def log_likelihood(model: Model, known: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """log10 probability of each text, without the counts of words in tail classes: those of common ones are added by
    their column, those of others after a join."""
    token = np.empty(len(known))
    for at, (_, target, z), (_, slot, inner), head in batches_of(model, known, _first(edges)):
        token[at] = _picked(z, target) / np.log(10) - model.tail_log[target]
        token[at][head] += _picked(inner, slot) / np.log(10)
    tail = np.maximum(known[:, 3], 0) * (known[:, 1] < 0)
    return np.add.reduceat(token + np.log10(tail + 1), edges[:-1])


def _picked(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the softmax's probability of each target."""
    own = z[np.arange(len(z)), target].astype(np.float64)
    return own - np.log(np.einsum("ij->i", np.exp(z, out=z), dtype=np.float64))


def _added_up(parts: DataFrame) -> DataFrame:
    """(block, part) with the parts of one partition's blocks added up; memory holds one of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(part.as_buffer(), np.float32)
                held[block] = held[block] + values if block in held else values.copy()
        yield _blocks(held)

    return parts.mapInArrow(run, "block int, part binary")


def _blocks(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "part"])


def gradient(docs: DataFrame, model: Model, text: str = "text") -> np.ndarray:
    """The gradient over all docs, added up in two shuffles; its fixed size comes to the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Words(sent.value), np.zeros(((1 << SHARED) + (1 << OWN), WIDE + 1), np.float32)
        waiting, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                waiting.append(value.as_py())
                size += len(waiting[-1] or "")
                if size > 1 << 20:
                    add_gradient(sent.value, *_texts(waiting, known)[:2], total)
                    waiting, size = [], 0
        if waiting:
            add_gradient(sent.value, *_texts(waiting, known)[:2], total)
        parts = total.reshape(BLOCKS, -1)
        yield _blocks({b: parts[b] for b in np.flatnonzero(parts.any(axis=1)).tolist()})

    parts = docs.select(text).mapInArrow(run, "block int, part binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    near = _added_up(parts.repartition("block", "salt").select("block", "part"))
    total = np.zeros((BLOCKS, ((1 << SHARED) + (1 << OWN)) * (WIDE + 1) // BLOCKS), np.float32)
    for r in _added_up(near.repartition("block").select("block", "part")).collect():  # BLOCKS rows
        total[r["block"]] = np.frombuffer(r["part"], np.float32)
    sent.unpersist()
    return total.reshape(-1, WIDE + 1)


def train(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """(model, counts (word, n) of every word) of docs."""
    docs = docs.select(F.col(text).alias("text"))
    counts = materialize(count_words(docs), "word-counts")

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((TAILS, 2), np.int64)
        for batch in batches:
            at = np.fromiter((tail_class(w) - HEADS for w in batch.column(0).cast(pa.binary()).to_pylist()), np.int64, len(batch))
            sums[:, 0] += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), TAILS).astype(np.int64)
            sums[:, 1] += np.bincount(at, minlength=TAILS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(HEADS, CLASSES, dtype=np.int32)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["c", "n", "v"])

    sums = counts.mapInArrow(classed, "c int, n bigint, v bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    tails = {r["c"]: (r["n"], r["v"]) for r in sums.collect()}  # TAILS rows
    common = [(r["word"].encode(), r["n"]) for r in counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(COMMON).toLocalIterator()]
    model = Model(common, tails)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, model.tokens // (ROUNDS * TASK_TOKENS))
    for r in range(ROUNDS if model.tokens else 0):
        model.moved(gradient(docs.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == r).coalesce(tasks), model))
    return model, counts


def score(docs: DataFrame, trained: tuple[Model, DataFrame], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all if None) with n_tokens, n_known, train_tokens, base_score and score."""
    model, counts = trained
    names = {"n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    own = [c for c in (docs.columns if keep is None else keep) if c not in names]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # the row's own columns ride in one struct, so that none can clash
    docs = docs.select(F.struct(*named(own)).alias("row") if own else F.lit(None).alias("row"), F.col(text).alias("text"))
    added = {"n": "bigint", "known": "bigint", "base": "double", "lm": "double", "rare": "array<string>"}

    def make():
        words = Words(sent.value)

        def rate(part: pa.Table) -> pa.Table:
            known, edges, flat = _texts(part.column("text").to_pylist(), words)
            count = known[:, 3]
            rare = np.flatnonzero(count < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, edges), pa.int32()), pa.array([flat[i] for i in rare], pa.binary()).cast(pa.string()))
            out = part.select(["row"]).append_column("n", pa.array(np.diff(edges)))
            out = out.append_column("known", pa.array(np.add.reduceat((count > 0).astype(np.int64), edges[:-1])))
            out = out.append_column("base", pa.array(np.add.reduceat(np.log10(np.maximum(count, 0) + 1.0), edges[:-1])))
            return out.append_column("lm", pa.array(log_likelihood(sent.value, known, edges))).append_column("rare", lists)

        return rate

    rated = map_slices(docs, make, declared(docs.select("row"), added))
    rated = materialize(rated.withColumn("serial", F.monotonically_increasing_id()), "rated")
    rare = rated.select("serial", F.explode("rare").alias("word")).join(counts, "word")
    found = rare.groupBy("serial").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("more_known"))
    both = rated.drop("rare").join(found, "serial", "left")
    more = F.coalesce("more", F.lit(0.0))
    # a word of count c has (c + 1) / (N + V + 1) in the base
    base = F.col("base") + more - F.col("n") * F.lit(float(np.log10(model.tokens + model.words + 1)))
    out = both.select("row", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("lm") + more).alias("score"))
    return out.select(*(["row.*"] if own else []), *names)
