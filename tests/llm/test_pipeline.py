"""The pipeline as a whole, held against plain versions of its stages on a small corpus."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import packing, pii

WORDS = {"en": ["the", "and", "thing", "where", "other", "house", "with", "then"], "fr": ["les", "une", "étaient", "leur", "maison", "même", "très", "aux"]}


def corpus() -> list[tuple]:
    rng, rows = random.Random(9), []
    for i in range(40):
        lang = "en" if i % 3 else "fr"
        text = " ".join(rng.choice(WORDS[lang]) + (str(i) if rng.random() < 0.3 else "") for _ in range(60))
        if i % 5 == 0:
            text += f" mail x{i}@example.com now"
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(40 + i, rows[i][1], rows[i][2], "s1", 1) for i in range(6)]
    rows += [(50, None, "en", "s0", 0), (51, "", "en", "s0", 0), (52, "12 34 56 !!", "en", "s0", 11)]
    return rows


def test_pipeline_takes_effect(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sequences":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    assert sorted(r["doc_id"] for r in seen["language_id"]) == [r[0] for r in rows if r[0] < 50]
    assert sorted(r["doc_id"] for r in seen["near_duplicates"]) == list(range(40))
    for r in seen["personal_data"]:
        assert "@" not in r["text"] and r["n_chars"] == len(r["text"]) and not pii.patterns(r["text"])[0]
        assert ("[EMAIL]" in r["text"]) == (r["doc_id"] % 5 == 0)
    total = {}
    for r in seen["mixture"]:
        total[r["source"]] = total.get(r["source"], 0) + len(r["text"].split())
    sizes = {}
    for r in seen["personal_data"]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    assert abs(sum(total.values()) - 1.5 * sum(sizes.values())) <= 70 * len(sizes)
    enc, want = packing.encoder(None), []
    for r in seen["mixture"]:
        ids = enc.ids(r["text"]) + bytes(4)
        want += [(r["doc_id"], s // 4, zlib.crc32(ids[s : s + 4096])) for s in range(0, len(ids), 4096)]
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in seen["sequences"]) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "mixture", "sequences"]


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    words = lambda k: " ".join(rng.choice(WORDS["en"]) + rng.choice(("", "s", "x1")) for _ in range(k))
    rows = [(i, words(50), "en", ("a", None, "b")[i % 3], 1) for i in range(12)]
    rows += [(None, words(40), None, "a", None), (None, words(40), "en", None, 3), (3, words(60), "en", "a", 2), (3, rows[3][1], "en", "a", 2)]
    rows += [(20, None, None, None, None), (21, "", "fr", "b", 0), (22, " \t\n", "fr", "b", 3), (23, words(200_000), "en", "b", None)]
    return rows + [rows[5]]


def test_every_stage_handles_edge_cases(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, extra clashing columns, empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    names = ("score", "lang_pred", "pii", "media", "size", "component_id", "target", "LABEL")
    for rows in (edge_rows(), [r for r in edge_rows() if r[0] in (20, 21, 22)], []):
        docs = spark.createDataFrame(rows, schema).withColumns({n: F.lit("mine") for n in names}).coalesce(2)
        out = {name: stage(spark, docs, "").collect() for name, stage in corpus_pipeline.STAGES}
        lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
        known = lettered if any(r[2] and r[1] is not None for r in rows) else []
        assert sorted(map(repr, (r["doc_id"] for r in out["language_id"]))) == sorted(repr(r[0]) for r in known)
        assert len(out["personal_data"]) == len(rows)
        assert {r["doc_id"] for r in out["near_duplicates"]} == {r[0] for r in rows}
        assert sum(r["doc_id"] is None for r in out["near_duplicates"]) == sum(r[0] is None for r in rows)
        assert sum(r["doc_id"] == 3 for r in out["near_duplicates"]) == sum(r[0] == 3 for r in rows) // 2
        assert {r["doc_id"] for r in out["mixture"]} <= {r[0] for r in rows if (r[1] or "").split()}
        assert sum(r["length"] for r in out["sequences"]) == sum(len(packing.encoder(None).ids(r[1] or "")) // 4 + 1 for r in rows)
        for name in ("language_id", "near_duplicates", "personal_data", "mixture"):
            assert all(r[n] == "mine" for r in out[name] for n in names)
        again = corpus_pipeline.mixture(spark, docs.repartition(3), "").collect()
        assert sorted(map(repr, again)) == sorted(map(repr, out["mixture"]))


def test_sequences_hold_their_token_ids(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, "more " * 2000)], "doc_id long, text string")
    rows = corpus_pipeline.sequences(spark, docs, "").collect()
    assert len(rows) > 2 and all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
