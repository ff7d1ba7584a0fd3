"""The registered queries on a folder of awkward rows: every column of a contract against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__
from kairoscope.llm import lang_id, max_entropy, packing, toxicity
from kairoscope.llm.bpe import load_ranks
from kairoscope.llm.queries import tokenizer

from .test_licenses import plain as plain_license
from .test_periodic import plain as plain_runs
from .test_quality import counts
from .test_simhash import linked
from .test_simhash import plain as fingerprint
from .test_toxicity import plain_score

WORDS = {"en": "the of and house river water light stone under".split(), "de": "der und haus fluss wasser licht stein über mit".split(), "ru": "дом река вода свет камень и на под".split()}
#: More columns, by the names that the queries and operators use themselves.
MORE = "held_out lang_pred score fingerprint component_id predicted payload_sha256 feature shard slot size law text_crc32 license dice n_tokens ids_sha256 kept n_words piece start sequence_id offset row key stream kind h k".split()


def rows():
    rng = random.Random(11)
    out = []
    for i in range(160):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang]) for _ in range(rng.choice([3, 60, 200]))]
        if i % 4 == 1:
            words[1:1] = ["idiotic", "moronic"] * 4
        out.append((i, " ".join(words), lang))
    out += [(200 + i, out[3][1], out[3][2]) for i in range(30)]  # copies
    out += [(300 + i, out[5][1] + f" tail {i}", None) for i in range(8)]  # near copies
    out += [(400, None, "en"), (401, "", "en"), (402, " \t\n", None), (403, "12 ! 34", "en"), (404, "漢字" * 40, None), (405, "x" * 5000, "en"), (406, "the river " * 30_000, "en"), (407, "All rights\n# reserved.", "en")]
    out += [(None, "the house of stone", "en"), (None, None, None), (7, out[7][1], out[7][2]), (7, out[7][1], out[7][2])]  # ids null or met twice
    return out


ROWS = rows()
LABELS = [(d, 1, int(d % 4 == 1)) for d, _, _ in ROWS if d is not None and d < 160] + [(None, 1, 1), (401, 1, None), (5000, 0, 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("awkward"))
    docs = spark.createDataFrame([(d, t, lang, "s", None if t is None else len(t), *["own"] * len(MORE)) for d, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in MORE))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def ask(spark, folder):
    def run(name):
        return __spark_entry__.queries()[name](spark, folder)

    return run


def types(df, **wanted):
    found = dict(df.dtypes)
    assert {c: found.get(c) for c in wanted} == wanted


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def crc(d, n, k):
    return d is not None and zlib.crc32(str(d).encode()) % n == k


def test_op1(spark, folder, ask):
    df = ask("op1_language_id")
    types(df, doc_id="bigint", held_out="boolean", lang_pred="string", score="double")
    got = df.collect()
    model = lang_id.train(spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    found = [lang_id.identify([t], model, lang_id.words_of(model)) for _, t, _ in ROWS]
    same([(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in got], [(d, crc(d, 3, 1), f["lang_pred"][0], round(f["score"][0], 9)) for (d, _, _), f in zip(ROWS, found)])
    plain = set(range(160))
    by_id = {r.doc_id: r for r in got}
    assert [(d, by_id[d].lang_pred, lang) for d, t, lang in ROWS if d in plain and len(t.split()) > 20 and by_id[d].lang_pred != lang] == []
    assert [by_id[d].lang_pred for d in (400, 401, 402, 403)] == ["und"] * 4


def test_op2(ask):
    df = ask("op2_simhash_near_dedup")
    types(df, doc_id="bigint", fingerprint="string", component_id="bigint")
    prints = [fingerprint(t) for _, t, _ in ROWS]
    names = linked(prints, [10**9 if d is None else d for d, _, _ in ROWS])
    same([tuple(r) for r in df.collect()], [(d, f"{p:016x}", c if c < 10**9 else None) for (d, _, _), p, c in zip(ROWS, prints, names)])


def test_op3(spark, folder, ask):
    df = ask("op3_toxicity")
    types(df, doc_id="bigint", held_out="boolean", score="double", predicted="int")
    got = df.collect()
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    want = {t: plain_score(model, t) for _, t, _ in ROWS}
    same([(r.doc_id, r.held_out) for r in got], [(d, crc(d, 5, 0)) for d, _, _ in ROWS])
    for r in got:
        assert r.predicted == int(r.score >= 0.5)
        assert any(abs(r.score - want[t]) < 1e-5 for d, t, _ in ROWS if d == r.doc_id)
    toxic = {r.doc_id: r.predicted for r in got}
    assert all(toxic[d] == int(d % 4 == 1) for d in range(160) if len(ROWS[d][1].split()) > 20 and d != 7)


def test_op4(ask):
    df = ask("op4_media_columns")
    types(df, doc_id="bigint", n_bytes="bigint", payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint", media_sha256="string", feature="string")
    want, media = [], {}
    for d, t, _ in ROWS:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    got = df.collect()
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], want)
    for r in got:
        assert media.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_op5(ask):
    df = ask("op5_sharding")
    types(df, doc_id="bigint", size="bigint", text_crc32="bigint", law="string", shard="int", slot="bigint", grown_shard="int")
    got = df.collect()
    same([(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got], [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for d, t, _ in ROWS])
    sizes = []
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        sizes.append(sum(r.size for r in own))
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got) and sum(map(bool, sizes)) > 1


def test_op6(ask):
    df = ask("op6_license_scan")
    types(df, doc_id="bigint", license="string", dice="double")
    want = []
    for d, t, _ in ROWS:
        name, dice, *_, every = plain_license(t)
        want.append((d, name, None if dice is None else round(dice, 6), ",".join(every)))
    same([(r.doc_id, r.license, r.dice, r.licenses) for r in df.collect()], want)


def test_op7(ask):
    df = ask("op7_byte_bpe")
    types(df, doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    ids = [enc.encode_ordinary(t or "") for _, t, _ in ROWS]
    want = [(d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (d, t, _), i in zip(ROWS, ids)]
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()], want)


def test_op8(ask):
    df = ask("op8_quality_rules")
    types(df, doc_id="bigint", **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint"), base_failed="boolean", kept="boolean")
    got = df.collect()
    want = [(d, *counts(t)) for d, t, _ in ROWS]
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], want)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_op9(ask):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(tokenizer()[1]), special_tokens={})
    same([(r.doc_id, r.n_tokens) for r in ask("op9_token_counts").collect()], [(d, len(enc.encode_ordinary(t or ""))) for d, t, _ in ROWS])


def test_op10(ask):
    df = ask("op10_best_fit_packing")
    types(df, doc_id="bigint", piece="int", start="bigint", length="bigint", ids_crc32="bigint", sequence_id="bigint", offset="bigint")
    file, want, sizes = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], []
    for d, t, _ in ROWS:
        ids = [*file.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for k, low in enumerate([0, *range(first, len(ids), 2048)]):
            piece = ids[low : low + 2048 if k else first]
            sizes.append(len(piece))
            want.append((d, k, low, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    got = df.collect()
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= packing.lower_bound(np.array(sizes)) + 1


def test_op11(ask):
    df = ask("op11_lm_scoring")
    types(df, doc_id="bigint", held_out="boolean", n_tokens="bigint", n_known="bigint", train_tokens="bigint", base_score="double", score="double")
    words = [[w.decode() for w in max_entropy.tokens(t)] for _, t, _ in ROWS]
    assert words == [[*(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))), ""] for _, t, _ in ROWS]
    held = [crc(d, 7, 2) for d, _, _ in ROWS]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n = sum(c.values())
    base = [sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws) for ws in words]
    got = df.collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got], [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, round(b, 5)) for (d, _, _), h, ws, b in zip(ROWS, held, words, base)])
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_op12(ask):
    df = ask("op12_periodic_runs")
    types(df, doc_id="bigint", **dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), "bigint"), runs_sha256="string", collapsed_sha256="string")
    want, changed = [], 0
    for d, t, _ in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if d is not None and words and (h := zlib.crc32(str(d).encode())) % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], changed + 1
        found = plain_runs(words) if len(words) < 9000 else [(0, len(words), 2)]
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((d, len(found), s, n, q, 1000 * n // q if n else None, *[hashlib.sha256(x.encode()).hexdigest() for x in (lines, left)]))
    assert changed > 10
    same([tuple(r) for r in df.collect()], want)


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)])
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert __spark_entry__.queries()[name](spark, str(tmp_path)).count() == 0
