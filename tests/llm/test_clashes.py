"""Extra columns whose names the operators use themselves."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kairoscope.llm import bpe, jpeg, lang_id, licenses, packing, quality, sharding, simhash, token_scan, toxicity
from kairoscope.llm.queries import tokenizer

NAMES = "fp score predicted lang_pred share n_spans spans ids offsets decoded media license dice template passage _p _b part bin offset room bins bound _serial kept n_words w h l_lang b_text k0 shard slot range serial size stream n kind _row sequence_id base_failed chars common".split() + ["a.b", "doc id"]
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(1, "the river and stone", "en"), (2, "the river and stone", "en"), (None, None, None), (3, "der fluss und stein", "de")], "doc_id long, text string, lang string")
    return base.select("*", *[F.lit("x").alias(n) for n in NAMES])


OPERATORS = {
    "language": lambda d: lang_id.predict(d, lang_id.train(d)),
    "near_duplicates": simhash.near_duplicates,
    "deduplicate": simhash.deduplicate,
    "toxicity": lambda d: toxicity.predict(d, toxicity.train(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))),
    "media": jpeg.media_columns,
    "sharding": lambda d: sharding.shard(sharding.keyed(d)),
    "licenses": licenses.scan,
    "encode": lambda d: bpe.decode(bpe.encode(d, PATH), PATH),
    "round_trip": lambda d: bpe.round_trip(d, PATH),
    "quality": quality.rules,
    "packing": lambda d: packing.pack(packing.pieces(d, tokenizer())),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_keeps_its_rows(docs, name):
    assert len(OPERATORS[name](docs).collect()) == (3 if name == "deduplicate" else 4)


def test_streams(spark, docs, tmp_path):
    token_scan.write_streams(docs, f"{tmp_path}/s", (*tokenizer(), ()))
    assert token_scan.token_counts(spark, f"{tmp_path}/s").count() == 4
