"""The registered opN_ queries: each applies its operator to a whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.llm import bpe, jpeg, lang_id, licenses, max_entropy, packing, periodic, quality, sharding, simhash, token_scan, toxicity
from kairoscope.llm.common import remainder, scratch_path
from kairoscope.sources.tables import table


def held_out(n: int, k: int) -> Column:
    """Never null: a row without an id is not held out."""
    return F.coalesce(remainder("doc_id", n) == k, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(3, 1))
    model = lang_id.train(docs.where(~F.col("held_out")))
    return lang_id.predict(docs, model, spans=False, keep=["doc_id", "held_out"])


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(5, 0))
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return toxicity.predict(docs, toxicity.train(docs, labels), keep=["doc_id", "held_out"])


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_columns(table(spark, sf_dir, "documents"), keep=["doc_id"], media=False, thumbs=False)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(sharding.keyed(table(spark, sf_dir, "documents")), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.withColumns({"dice": F.round("dice", 6), "licenses": F.array_join("licenses", ",")})


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=["doc_id"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.rules(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("js_chars", "js_words")})


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-streams")
    token_scan.write_streams(table(spark, sf_dir, "documents"), path, (*tokenizer(), ()))  # no special tokens: their strings are ordinary text
    return token_scan.token_counts(spark, path)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer())
    return packing.pack(cut)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(7, 2).alias("held_out"))
    return max_entropy.score(docs, max_entropy.train(docs.where(~F.col("held_out"))), keep=["doc_id", "held_out"])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic.find_runs(docs, keep=["doc_id"]).select("doc_id", *[c.alias(n) for n, c in periodic.digest(F.col("runs"), F.col("collapsed")).items()])


def tokenizer() -> tuple[str, str, str]:
    """The 50k byte-level BPE: its tokenizers file, its ranks and its split pattern."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash_near_dedup, op3_toxicity, op4_media_columns, op5_sharding, op6_license_scan, op7_byte_bpe, op8_quality_rules, op9_token_counts, op10_best_fit_packing, op11_lm_scoring, op12_periodic_runs)}


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    t, rows = licenses.THRESHOLD, []
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        words = licenses.normalized(text)
        pairs = licenses.bigrams(words)
        rows.append(f"({k}, {quoted(name)}, {len(words)}, {licenses.reach(len(pairs), t)}, [{', '.join(map(quoted, pairs))}])")
    return rf"""
    WITH t(k, license, words, most, pairs) AS (VALUES {', '.join(rows)}),
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]) AS b FROM w WHERE len(w) > 1),
    placed AS (SELECT doc_id, unnest(b) AS x, unnest(range(len(b))) AS p FROM b),
    hits AS (SELECT doc_id, k, words, most, p FROM placed JOIN (SELECT k, words, most, unnest(pairs) AS x FROM t) USING (x)),
    reached AS (SELECT doc_id, k, p, most, unnest([words - 1, most]) AS far FROM hits),
    runs AS (SELECT r.doc_id, r.k, r.p, max(q.p) AS last FROM reached r JOIN hits q ON q.doc_id = r.doc_id AND q.k = r.k AND q.p >= r.p AND q.p < r.p + r.far GROUP BY r.doc_id, r.k, r.p, r.far),
    m AS (
      SELECT doc_id, k, license, p, last - p + 2 AS n, 2.0::DOUBLE * len(list_intersect(s, pairs)) / (len(s) + len(pairs)) AS dice
      FROM (SELECT doc_id, k, license, p, last, pairs, list_distinct(b[p + 1:last + 1]) AS s FROM runs JOIN t USING (k) JOIN b USING (doc_id))
    ),
    good AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, k, p, n DESC) AS r FROM m WHERE dice >= {t}),
    every AS (
      SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM good g
      WHERE NOT EXISTS (SELECT 1 FROM good o WHERE o.doc_id = g.doc_id AND o.license <> g.license AND o.p < g.p + g.n AND g.p < o.p + o.n AND (o.dice > g.dice OR (o.dice = g.dice AND (o.k < g.k OR (o.k = g.k AND (o.p < g.p OR (o.p = g.p AND o.n > g.n)))))))
      GROUP BY doc_id)
    SELECT d.doc_id, license, round(dice, 6) AS dice, k::INT AS template, p::INT AS first_word, n::INT AS n_words, coalesce(licenses, '') AS licenses
    FROM documents d LEFT JOIN (SELECT * FROM good WHERE r = 1) USING (doc_id) LEFT JOIN every USING (doc_id)
    """


def _distance_sql(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    a, b = f"list_transform({p}, lambda x: x / nullif(list_sum({p}), 0))", f"list_transform({q}, lambda x: x / nullif(list_sum({q}), 0))"
    part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(list_zip({a}, {b}), lambda z: ({part.format('z[1]')} + {part.format('z[2]')}) / 2)))) END"


_QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
each AS (SELECT doc_id, lang, unnest(w) AS x FROM d),
top AS (
  SELECT lang, x, n FROM (SELECT lang, x, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, x) AS r FROM each GROUP BY lang, x) WHERE r <= 16
),
hits AS (SELECT e.doc_id, e.lang, e.x, count(*) AS n FROM each e JOIN top USING (lang, x) GROUP BY ALL),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) AS s FROM d WHERE len(w) > 2),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM again, range(3) AS r(k) GROUP BY doc_id),
h AS (
  SELECT d.doc_id, list(coalesce(hits.n, 0) ORDER BY top.x) AS c FROM d JOIN top USING (lang) LEFT JOIN hits ON hits.doc_id = d.doc_id AND hits.x = top.x GROUP BY d.doc_id
),
m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[\p{{Ll}}\x20\x09-\x0D]', '', 'g')) AS marks, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS up,
    length(regexp_replace(text, '[^\p{{N}}]', '', 'g')) AS digit, length(regexp_replace(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[\p{{Ll}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{M}}]', '', 'g')) AS mk,
    list_append(coalesce(h.c, []), len(w) - coalesce(list_sum(h.c), 0))::DOUBLE[] AS common
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN h USING (doc_id)
),
c AS (SELECT *, [word_chars - marks, up, letters - up, mk, digit, n_symbols, marks - letters - mk - digit - n_symbols]::DOUBLE[] AS chars FROM m),
rc AS (SELECT lang, list(s ORDER BY i)::DOUBLE[] AS r_chars FROM (SELECT lang, i, sum(chars[i]) AS s FROM c, range(1, 8) AS r(i) GROUP BY lang, i) GROUP BY lang),
rw AS (SELECT lang, list(s ORDER BY i)::DOUBLE[] AS r_common FROM (SELECT lang, i, sum(common[i]) AS s FROM (SELECT lang, common, unnest(range(1, len(common) + 1)) AS i FROM c) GROUP BY lang, i) GROUP BY lang),
j AS (SELECT c.*, {_distance_sql("chars", "r_chars")} AS js_chars, {_distance_sql("common", "r_common")} AS js_words FROM c JOIN rc USING (lang) JOIN rw USING (lang)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((word_chars >= 100 AND js_chars > 0.3) OR (n_words >= 50 AND js_words > 0.4), false) AS kept,
  round(js_chars, 6) AS js_chars, round(js_words, 6) AS js_words
FROM f
"""

ORACLE_SQL: dict[str, str] = {"op6_license_scan": _license_sql(), "op8_quality_rules": _QUALITY_SQL}
