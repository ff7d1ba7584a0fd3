"""Periodic runs of words: Main-Lorentz divide and conquer on interned word ids, all midpoints of a level side by side.

A run is a longest stretch of words with smallest period q (words q apart are equal) of at least max(SHORTEST, 2 q)
words. Words get numbers of their own in each document, so nothing matches across documents. Documents are halved down
to blocks of 16 words; a run crosses the midpoint of some block. About a midpoint m a run of period q shows as a stretch
of equal pairs (i, i + q) with i or i + q at m or just before it: the Z-function of the words from m on, and the one
backwards from m, against the block's other positions. Runs of 12 words and more need values of three or more there, so
only those are looked at: positions whose three words are those at the midpoint. Each such pair is extended to both
sides as far as it goes, past the block too: up to NEAR words word by word, beyond that by doubling (numbers for the
stretches of 1, 2, 4 and more words of the documents in question), so that a text of one repeated word stays at
O(n log^2 n). Intervals found at several midpoints or with several periods are one run of the smallest period.

Defined results: null texts and texts without words have no runs and no kept words. Repeated rows give repeated results.
A text is held whole by one task, with working arrays of some twenty times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.common import declared, map_slices, named, offsets

SHORTEST = 12
#: A block is halved while it is larger; runs of SHORTEST words fit in no smaller one.
LEAF = 16
#: Words to each side by which a pair is extended word by word.
NEAR = 12


def runs_of(word: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period; start counts from the document's first word.

    word: numbers of the words of all documents, none in two documents; edges: where each document begins and ends.
    """
    three = _mixed(word)
    pairs = [_pairs(three, edges, half) for half in _halves(edges)]
    low, high = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    doc = np.searchsorted(edges, low, "right") - 1
    within = high < edges[doc + 1]
    low, high, doc = low[within], high[within], doc[within]
    first, last = _stretches(word, edges, doc, low, high)
    q = high - low
    size = last - first + q
    good = (last - first >= q) & (size >= SHORTEST)
    doc, first, size, q = doc[good], first[good], size[good], q[good]
    order = np.lexsort((q, size, first))
    doc, first, size, q = doc[order], first[order], size[order], q[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (size[1:] != size[:-1])  # the smallest period of an interval comes first
    doc, first, size, q = doc[new], first[new], size[new], q[new]
    order = np.lexsort((q, first))
    return doc[order], (first - edges[doc])[order], size[order], q[order]


def _halves(edges: np.ndarray):
    half, longest = LEAF // 2, int(np.diff(edges).max(initial=0))
    while half < longest:
        yield half
        half *= 2


def _pairs(three: np.ndarray, edges: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: positions whose three words are equal, one of them at, or three before, the midpoint of a block of
    2 * half words that holds the other."""
    size = np.diff(edges)
    blocks = np.maximum(0, -(-(size - half) // (2 * half)))  # of each document: those with a right half
    owner = np.repeat(np.arange(len(size)), blocks)
    start = edges[owner] + 2 * half * (np.arange(len(owner)) - np.repeat(offsets(blocks)[:-1], blocks))
    width = np.minimum(2 * half, edges[owner + 1] - start)
    place = np.arange(width.sum()) + np.repeat(start - offsets(width)[:-1], width)
    own = three[place]
    low, high = [], []
    for back in (0, 3):
        middle = start + half - back
        hit = np.flatnonzero(own == np.repeat(three[middle], width))
        at, mid = place[hit], middle[np.searchsorted(offsets(width), hit, "right") - 1]
        other = at != mid
        low.append(np.minimum(at, mid)[other])
        high.append(np.maximum(at, mid)[other])
    return np.concatenate(low), np.concatenate(high)


def _mixed(word: np.ndarray) -> np.ndarray:
    """A number for each three words that follow one another; equal numbers of different words are sorted out when pairs are extended."""
    w = word.astype(np.uint64)
    out = np.full(len(w), ~np.uint64(0))
    out[:-2] = (w[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) << np.uint64(1)) ^ (w[2:] * np.uint64(0x165667B19E3779F9) >> np.uint64(1))
    return out


def _stretches(word: np.ndarray, edges: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[first, last): the longest stretch of places i about `low` such that the words at i and i + high - low are equal."""
    begin, end, gap = edges[doc], edges[doc + 1], high - low
    last, first = low.copy(), low.copy()
    for ahead, edge in ((True, last), (False, first)):
        open_ = np.arange(len(low))
        for _ in range(NEAR):
            i = edge[open_] if ahead else edge[open_] - 1
            inside = i + gap[open_] < end[open_] if ahead else i >= begin[open_]
            i = np.where(inside, i, begin[open_])
            same = inside & (word[i] == word[np.where(inside, i + gap[open_], i)])
            open_ = open_[same]
            edge[open_] += 1 if ahead else -1
        if len(open_):
            _double(word, edges, doc, gap, edge, open_, ahead)
    return first, last


def _double(word: np.ndarray, edges: np.ndarray, doc: np.ndarray, gap: np.ndarray, edge: np.ndarray, open_: np.ndarray, ahead: bool) -> None:
    """Move edge[open_] as far as words gap apart stay equal, by numbers for stretches of 1, 2, 4 and more words."""
    for d in np.unique(doc[open_]):
        mine = open_[doc[open_] == d]
        base = int(edges[d])
        levels = [word[base : int(edges[d + 1])]]
        n = len(levels[0])
        while (step := 1 << (len(levels) - 1)) * 2 <= n:
            before = levels[-1].astype(np.int64)
            both = before[: n - 2 * step + 1] * (int(before.max()) + 1) + before[step : n - step + 1]
            levels.append(np.unique(both, return_inverse=True)[1])
        at, apart = edge[mine] - base, gap[mine]
        for k in reversed(range(len(levels))):
            numbers, step = levels[k], 1 << k
            i = at if ahead else at - step
            fits = (i >= 0) & (i + apart < len(numbers))
            i = np.where(fits, i, 0)
            at = np.where(fits & (numbers[i] == numbers[np.where(fits, i + apart, 0)]), at + (step if ahead else -step), at)
        edge[mine] = at + base


def interned(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, edges of the documents); a word has another number in each document."""
    edges = offsets([len(t) for t in texts])
    out, base = np.empty(edges[-1], np.int64), 0
    for words, a, b in zip(texts, edges[:-1].tolist(), edges[1:].tolist()):
        numbers: dict[bytes, int] = {}
        out[a:b] = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        out[a:b] += base
        base += len(numbers)
    return out, edges


def kept(edges: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    change = np.zeros(edges[-1] + 1, np.int64)
    np.add.at(change, edges[doc] + start + q, 1)
    np.add.at(change, edges[doc] + start + size, -1)
    return np.cumsum(change)[:-1] == 0


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all if None) with runs, an array of (start, length, period) by start and period, and
    collapsed, the words that stay joined by single spaces."""
    added = {"runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}
    own = [c for c in (docs.columns if keep is None else keep) if c not in added]
    docs = docs.select(*named(dict.fromkeys([*own, text])))

    def make():
        def search(part: pa.Table) -> pa.Table:
            texts = [(t or "").encode().split() for t in part.column(text).to_pylist()]  # splits at the six ASCII white spaces
            word, edges = interned(texts)
            doc, start, size, q = runs_of(word, edges)
            stay = kept(edges, doc, start, size, q)
            left = np.split(stay, edges[1:-1]) if len(texts) else []
            words = [t if s.all() else [t[i] for i in np.flatnonzero(s)] for t, s in zip(texts, left)]
            fields = pa.StructArray.from_arrays([pa.array(start), pa.array(size), pa.array(q)], names=["start", "length", "period"])
            found = pa.ListArray.from_arrays(pa.array(offsets(np.bincount(doc, minlength=len(texts))), pa.int32()), fields)
            return part.select(own).append_column("runs", found).append_column("collapsed", pa.array([b" ".join(w).decode() for w in words], pa.string()))

        return search

    return map_slices(docs, make, declared(docs.select(*named(own)), added), text)


def digest(runs: Column, collapsed: Column) -> dict[str, Column]:
    """Columns that sum up find_runs(): number of runs, the longest (ties: first start, then period) and two hashes."""
    best = F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    best = F.get(best, F.lit(0))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return {
        "n_runs": F.size(runs).cast("bigint"), "start": best["s"], "length": -best["l"], "period": best["p"], "exponent_milli": F.floor(-1000 * best["l"] / best["p"]).cast("bigint"),
        "runs_sha256": F.sha2(F.array_join(F.transform(runs, line), ""), 256), "collapsed_sha256": F.sha2(collapsed, 256),
    }


def planted(text: Column, key: Column) -> Column:
    """The contract's texts: of the ids whose crc32 ends in 0, words from one on repeat with a period of a few to a third
    of the rest. Both follow from the id alone; other texts, and those without words, stay as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # an array of one holds the words, so that they are cut once and not for each of them
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(text)
