"""The pipeline's stages over a small corpus, each held against what it got."""

import random

import pytest

import corpus_pipeline
from quorumlake.llm import secrets


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        text = " ".join(f"word{rng.randrange(900)}" for _ in range(rng.randrange(20, 200)))
        bad = i % 6 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 25 == 1:
            text += " password: abcdef123"
        elif i % 40 == 3:
            text = rows[i - 2][1]  # a copy of a good document
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_take_effect_in_order(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept.append(docs)
    good, once, clean, mixed, packed = kept
    ids = {r.doc_id for r in good.collect()}
    assert not any(i % 6 == 0 for i in ids) and len(ids) >= 245
    texts = [r.text for r in once.collect()]
    assert len(texts) == len(set(texts)) and len(texts) < len(ids) + 1
    assert clean.count() == once.count() and secrets.scan(clean).filter("n_assign + n_access + n_hex > 0").count() == 0
    words = sum(len(r.text.split()) for r in mixed.collect())
    assert words == pytest.approx(sum(len(r.text.split()) for r in clean.collect()), rel=0.02)
    assert packed.agg({"n_words": "sum"}).first()[0] == words


def test_run_is_all_stages(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 0


def hard_docs():
    long_text = " ".join(f"w{i * i % 7919}" for i in range(9000))
    rows = [(1, long_text, "en", "a", 5), (2, long_text, "en", "b", 5), (2, long_text, "en", "b", 5), (3, "", "en", "a", 0), (4, None, None, None, None), (None, None, None, None, None)]
    rows += [(None, "no id, and a secret: abcdef123", "en", None, 3), (None, "no id, and a secret: abcdef123", "en", None, 3), (6, "tie tie tie tie tie tie", "fr", "a", 2), (7, "tie tie tie tie tie tie", "fr", "a", 2), (8, " \n ", "en", "ä", 3)]
    return rows


@pytest.fixture(scope="module")
def hard_corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hard"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_hard_rows_and_on_nothing(spark, hard_corpus, name, stage):
    """Nulls, empty and long texts, repeats, ties and clashing columns: what each stage's docstring says of them."""
    rows = hard_docs()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS digest", "3 AS tie", "4 AS size", "5 AS predicted")
    out = stage(spark, docs, hard_corpus)
    got = [r.asDict() for r in out.collect()]
    ids = sorted((r["doc_id"] or -1) for r in got)
    n_words = sum(len((t or "").split()) for _, t, *_ in rows)
    if name == "quality classifier":
        assert ids == sorted((r[0] or -1) for r in rows)
    elif name == "near-duplicates":
        assert sorted((r["doc_id"] or -1, r["text"] is None) for r in got) == [(-1, False), (-1, True), (1, False), (3, False), (4, True), (6, False), (8, False)]
    elif name == "secrets":
        assert len(got) == len(rows) and sum("[assign]" in (r["text"] or "") for r in got) == 2 and not any("abcdef123" in (r["text"] or "") for r in got)
    elif name == "source mix":
        assert all(r["text"] and r["n_chars"] == len(r["text"]) for r in got) and abs(sum(len(r["text"].split()) for r in got) - n_words) <= 1
    else:
        assert sum(r["n_words"] for r in got) == n_words and sum(r["bin_id"] is None for r in got) == 4
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS
    assert stage(spark, spark.createDataFrame([], SCHEMA), hard_corpus).count() == 0
