"""One very long text, beside short ones, through every operator on texts and every stage of the pipeline.

LONG_TEXT_BYTES sets its size; 50,000,000 takes a quarter of an hour.
"""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import jaccard, language, mixing, ogg, packing, pii, quality, spelling, suffixes

SIZE = int(os.environ.get("LONG_TEXT_BYTES", 3_000_000))


@pytest.fixture(scope="module")
def docs(spark):
    """The long text is made by Spark: sentences of changing words, an address and a number now and then."""
    line = F.concat(F.lit("the other house "), F.col("i").cast("string"), F.lit(" and then w"), F.hex(F.xxhash64("i")), F.lit(" where "))
    long = spark.range(SIZE // 60).select(F.col("id").alias("i")).select("i", F.when(F.col("i") % 5000 == 0, F.concat(F.lit("mail x"), F.col("i").cast("string"), F.lit("@example.com now "))).otherwise(line).alias("l"))
    text = long.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "l"))), lambda s: s["l"]), "").alias("text"))
    short = spark.createDataFrame([(1, "the other house is there and then some more words"), (2, None), (3, "")], "doc_id long, text string")
    both = short.unionByName(text.select(F.lit(9).cast("long").alias("doc_id"), "text"))
    return both.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).cache()


def test_every_operator(docs, spark):
    size = docs.filter("doc_id = 9").select(F.octet_length("text")).first()[0]
    assert size > 0.9 * SIZE
    assert sum(r["taken"] for r in mixing.taken(*mixing.mix(docs)).collect()) > 0
    named = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.learn(docs)).select("doc_id", "lang_pred").collect()}
    assert named == {1: "en", 2: "und", 3: "und", 9: "en"}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.joined(docs).collect()} == {1: 1, 2: 2, 3: 3, 9: 9}
    assert quality.classify(docs, quality.Ensemble()).select("score").count() == 4
    pieces = packing.packed(docs, keep_ids=False)
    assert pieces.filter("doc_id = 9").agg(F.sum("length") == F.max("doc_tokens")).first()[0]
    media = {r["doc_id"]: r for r in ogg.read_back(ogg.stored(docs.select("doc_id", "text"))).select("doc_id", "n_bytes", "__read.payload_sha256").collect()}
    assert media[9]["n_bytes"] == size and media[2]["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest()
    found = {r["doc_id"]: r["n_email"] for r in pii.digest(docs, pii.learn(docs)).collect()}
    assert found == {1: 0, 2: 0, 3: 0, 9: -(-(SIZE // 60) // 5000)}


def test_words_and_repeats(docs):
    """The long text is made of lines that differ by a number, so no 400 bytes of it repeat; beside a copy of its half, that half does."""
    words = {r["word"]: r["n"] for r in spelling.variants(docs).collect()}
    assert words["house"] > 0.9 * (SIZE // 60) and "there" not in words
    half = docs.filter("doc_id = 9").select(F.lit(10).cast("long").alias("doc_id"), F.expr("substring(text, 1, length(text) div 2)").alias("text"))
    rows = {r["doc_id"]: (r["size"], r["kept"]) for r in suffixes.without_repeats(docs.select("doc_id", "text").unionByName(half)).select("doc_id", F.octet_length("text").alias("size"), F.octet_length("kept").alias("kept")).collect()}
    assert rows[10][1] == 0 and rows[9][0] - rows[9][1] == rows[10][0] and rows[3] == (0, 0)


def test_every_stage(docs, spark):
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        seen[name] = out.select("doc_id").distinct().count()
    assert seen == {"language_id": 2, "near_duplicates": 4, "personal_data": 4, "mixture": 2, "sequences": 4}
