"""Language identification: script ranges, per-word scores, Viterbi over mixed-language spans.

Scripts narrow the candidates of a word, hashed character n-grams score it under each candidate, and a Viterbi
path with a penalty for each switch labels spans. The document's language is the one with most letters.

Defined results: null text, or text without a letter, gives `und` and score 0. Ties go to the language that sorts
first. With one learned language all text in its scripts is of it, with none every text is `und`. Labels
beyond the MOST_LANGUAGES commonest are not learned. Rows are never merged, so repeated rows give repeated results. Other columns are left alone unless they
have the name of an output column, which then replaces them. Whole texts are read, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.common import LETTERS, Words, declared, map_slices, named, ngrams, offsets, sums

UND = "und"
#: Languages that are learned, the commonest first: their scores go to every worker, a quarter of a MB each.
MOST_LANGUAGES = 500

# First code points of Unicode script blocks and the script that begins there.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Other"), (0x0E00, "Thai"),
    (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0x10000, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_SCRIPT_AT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])


def script_of(words: list[str]) -> np.ndarray:
    """Number in SCRIPTS of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT_AT[np.searchsorted(_STARTS, first, "right") - 1]


class Model:
    """Per-language log weights of hashed n-grams (1 to 4 characters) and which scripts each language uses."""

    BITS, LOW, HIGH = 16, 1, 4

    def __init__(self, langs: list[str], weights: np.ndarray, scripts: np.ndarray):
        self.langs, self.weights, self.scripts = langs, weights, scripts

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], script_share: float = 0.01) -> Model:
        """rows: (text, language). Counts are smoothed by 0.5; a script counts from `script_share` of the words."""
        langs = sorted({lang for _, lang in rows})
        if not langs:
            return cls([], np.zeros((1 << cls.BITS, 0), np.float32), np.zeros((0, len(SCRIPTS)), bool))
        counts = np.full((1 << cls.BITS, len(langs)), 0.5, np.float32)
        seen = np.zeros((len(langs), len(SCRIPTS)))
        tallies: list[dict[str, int]] = [{} for _ in langs]
        number = {lang: k for k, lang in enumerate(langs)}
        for text, lang in rows:
            tally = tallies[number[lang]]
            for w in LETTERS.findall(text.lower()):
                tally[w] = tally.get(w, 0) + 1
        for k, tally in enumerate(tallies):
            if tally:
                n = np.fromiter(tally.values(), np.float64, len(tally))
                owner, bucket = ngrams(list(tally), cls.LOW, cls.HIGH, cls.BITS)
                counts[:, k] += np.bincount(bucket, n[owner], 1 << cls.BITS)
                seen[k] = np.bincount(script_of(list(tally)), n, len(SCRIPTS))
        logs = np.log(np.divide(counts, counts.sum(axis=0, dtype=np.float64), out=counts, casting="same_kind"), out=counts)
        logs -= logs.mean(axis=1, keepdims=True)
        return cls(langs, np.clip(logs, -6, 6, out=logs), seen > script_share * np.maximum(1, seen.sum(axis=1, keepdims=True)))

    def score(self, words: list[str]) -> np.ndarray:
        """[words, languages + 1]: summed n-gram weights over the number of orders; -12 outside a word's scripts, unless
        no language has it (0). The last column is 1 if some language uses the word's script."""
        owner, bucket = ngrams(words, self.LOW, self.HIGH, self.BITS)
        out = np.stack([np.bincount(owner, self.weights[bucket, k], len(words)) for k in range(len(self.langs))], axis=1)
        out = np.clip(out / (self.HIGH - self.LOW + 1), -8, 8)
        allowed = self.scripts[:, script_of(words)].T
        out[~allowed] = -12
        used = allowed.any(axis=1)
        out[~used] = 0
        return np.column_stack([out, used]).astype(np.float32)


def steady(scores: np.ndarray, edges: np.ndarray, best: np.ndarray, penalty: float) -> np.ndarray:
    """Documents whose best path provably never leaves `best`.

    No span may gain more than half a penalty over the document's best language: a path with m other spans gains
    at most m/2 penalties and pays at least m-1 of them, and for m = 1 it pays one or is itself a constant path.
    """
    sizes = np.diff(edges)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    own = scores[np.arange(len(scores)), best[doc]]
    ok = np.ones(len(sizes), bool)
    full = np.flatnonzero(sizes)
    if not len(full):
        return ok
    for k in range(scores.shape[1]):
        gain = (scores[:, k] - own).astype(np.float64)
        upto = np.cumsum(gain)
        level = 40.0 * (len(gain) + 1)  # above any sum: each document starts below all values of those before it
        upto -= level * doc
        low = np.minimum.accumulate(upto - gain)
        start = upto[edges[:-1][full]] - gain[edges[:-1][full]]
        low = np.minimum(low, np.repeat(start, sizes[full]))
        ok[full] &= np.maximum.reduceat(upto - low, edges[:-1][full]) <= penalty / 2
    return ok


def viterbi(scores: np.ndarray, edges: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word: sum of scores less `penalty` for each change of label, within each document."""
    label = np.zeros(len(scores), np.int64)
    sizes = np.diff(edges)
    total = sums(scores, edges)
    best = total.argmax(axis=1)
    label[:] = np.repeat(best, sizes)
    todo = np.flatnonzero(~steady(scores, edges, best, penalty))
    if not len(todo):
        return label
    todo = todo[np.argsort(-sizes[todo], kind="stable")]
    start, length = edges[todo], sizes[todo]
    width = scores.shape[1]
    number = np.uint8 if width <= 256 else np.uint16  # MOST_LANGUAGES is over 256
    back = np.zeros((len(scores), width), number)
    same = np.arange(width, dtype=number)
    value = scores[start].astype(np.float64)
    final = np.zeros(len(todo), np.int64)
    live = len(todo)
    for t in range(1, int(length[0]) + 1):
        now = int(np.searchsorted(-length, -t))  # documents longer than t
        if now < live:
            final[now:live] = value[now:live].argmax(axis=1)
            live = now
        if not live:
            break
        value = value[:live]
        top = value.argmax(axis=1)
        moved = value[np.arange(live), top][:, None] - penalty
        stay = value >= moved
        at = start[:live] + t
        back[at] = np.where(stay, same, top[:, None])
        value = np.where(stay, value, moved) + scores[at]
    now = final.copy()
    for t in range(int(length[0]) - 1, -1, -1):
        live = int(np.searchsorted(-length, -t))
        at = start[:live] + t
        label[at] = now[:live]
        now[:live] = back[at, now[:live]]
    return label


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = 400, bytes_per_lang: int = 4 << 20) -> Model:
    """Fit on a bounded sample: about `docs_per_lang` documents of each language, chosen by a hash of the key, and at
    most `bytes_per_lang` bytes of them. Rows without text or language teach nothing, nor do labels beyond the
    MOST_LANGUAGES commonest."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.lit("lang-sample"), key).alias("h"), F.octet_length(text).alias("n"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("count"), F.sum("n").alias("bytes"))
    counts = [(r["lang"], r["count"], r["bytes"]) for r in sizes.orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    shares = [(name, max(1, int(min(1.0, docs_per_lang / count, bytes_per_lang / max(1, size)) * (1 << 30)))) for name, count, size in counts]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, most long")
    chosen = rows.where(F.col("n") <= bytes_per_lang).join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("most"))
    # one row for a hash: rows that repeat an id cannot swell the sample
    sample = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return Model.fit([(r["text"], r["lang"]) for r in sample.orderBy("lang", "h").collect()])


def predict(docs: DataFrame, model: Model, text: str = "text", penalty: float = 8.0, spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score, share (of letters in words of the predicted language), known, n_spans and, if asked, spans.

    keep: the columns of docs to return, all if None.

    share: words in a script that the language does not use count as not its own, so text in a script never seen has
    share 0; known: the same over all languages, so mixed text is fully known. Both ask which scripts a language uses,
    not how its words score: of one learned language every word in its scripts is known. score: share times the mean of
    1 and the posterior of the predicted language. spans: array of (start, end, lang), in code points.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.scripts))
    added = {"lang_pred": "string", "score": "double", "share": "double", "known": "double", "n_spans": "int"} | ({"spans": "array<struct<start:int,end:int,lang:string>>"} if spans else {})
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {*added, "spans"}]
    docs = docs.select(*named(dict.fromkeys([*kept, text])))
    schema = declared(docs.select(*named(kept)), added)

    def make():
        known = Model(*broadcast.value)
        table = words_of(known)

        def label(part: pa.Table) -> pa.Table:
            out = identify(part.column(text).to_pylist(), known, table, penalty, spans)
            part = part.select(kept)
            for name in added:
                part = part.append_column(name, pa.array(out[name], _ARROW[name]))
            return part

        return label

    return map_slices(docs, make, schema, text)


def words_of(model: Model) -> Words:
    return Words(model.score, len(model.langs) + 1)


_ARROW = {"lang_pred": pa.string(), "score": pa.float64(), "share": pa.float64(), "known": pa.float64(), "n_spans": pa.int32(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))}


def identify(texts: list[str | None], model: Model, table: Words, penalty: float = 8.0, spans: bool = True) -> dict[str, list]:
    """The columns that predict() adds, for a list of texts."""
    n, width = len(texts), len(model.langs)
    found = [LETTERS.findall((t or "").lower()) for t in texts]
    lettered = [any(c.isalpha() for w in ws for c in w) for ws in found]
    found = [ws if ok and width else [] for ws, ok in zip(found, lettered)]
    edges = offsets([len(ws) for ws in found])
    flat = [w for ws in found for w in ws]
    out = {"lang_pred": [UND] * n, "score": [0.0] * n, "share": [0.0] * n, "known": [0.0] * n, "n_spans": [0] * n, "spans": [[] for _ in range(n)]}
    if not flat:
        return out
    rows = table.look_up(flat)
    scores, used = np.ascontiguousarray(rows[:, :width]), rows[:, width] > 0
    letters = np.fromiter(map(len, flat), np.float64, len(flat))
    label = viterbi(scores, edges, penalty)
    doc = np.repeat(np.arange(n), np.diff(edges))
    mass = np.bincount(doc * width + label, letters, n * width).reshape(n, width)
    total = sums(scores, edges)
    chance = np.exp(np.clip(total - total.max(axis=1, keepdims=True), -60, 0))
    chance /= chance.sum(axis=1, keepdims=True)
    best = mass.argmax(axis=1)
    own = scores[np.arange(len(flat)), label]
    held = np.bincount(doc * width + label, letters * ((own > -12) & used), n * width).reshape(n, width)
    share = held[np.arange(n), best] / np.maximum(1, mass.sum(axis=1))
    change = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    runs = np.bincount(doc[change], minlength=n)
    for i in np.flatnonzero(np.diff(edges)).tolist():
        out["lang_pred"][i] = model.langs[best[i]]
        out["share"][i] = float(share[i])
        out["score"][i] = float(min(1.0, share[i] * (1 + chance[i, best[i]]) / 2))
        out["known"][i] = float(held[i].sum() / mass[i].sum())
        out["n_spans"][i] = int(runs[i])
        if spans:
            places = [m.span() for m in LETTERS.finditer(texts[i].lower())] if len(texts[i].lower()) == len(texts[i]) else _places(texts[i])
            own = label[edges[i] : edges[i + 1]]
            cut = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            out["spans"][i] = [{"start": places[a][0], "end": places[b - 1][1], "lang": model.langs[own[a]]} for a, b in zip(cut, cut[1:])]
    return out


def _places(text: str) -> list[tuple[int, int]]:
    """Spans of the lower-cased words in the text as it was, where lower-casing changes lengths."""
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    lowered = "".join(c.lower() for c in text)
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in LETTERS.finditer(lowered)]
