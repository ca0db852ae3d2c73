"""The pipeline's stages on a small corpus with planted cases."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tracklens.llm import queries


def text(n, seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 400, n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for k in range(400):
        t = text(40, k)
        if k % 8 == 0:
            t += " you idiot , you moron"
        rows.append((k, t, "en", f"s{k % 5}", len(t)))
        labels.append((k, 1, int(k % 8 == 0)))
    rows += [(1000 + k, text(40, 1), "en", "s1", 0) for k in range(30)] + [(2000, text(40, 2) + " tail", "en", "s2", 0), (3000, text(40, 999) + " call me@x.org", "en", "s3", 0), (4000, None, None, None, None), (None, text(9, 7), "en", "s4", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        docs.write.parquet(f"{corpus}/{name}")
        docs = spark.read.parquet(f"{corpus}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {r["doc_id"] for r in seen["toxicity"]}
    assert len(ids & set(range(0, 400, 8))) <= 2 and len(ids & {k for k in range(400) if k % 8}) >= 340
    ids = [r["doc_id"] for r in seen["near_duplicates"]]
    assert len(ids) == len(set(ids)) and 1 in ids and not {1000 + k for k in range(30)} & set(ids) and (2 not in ids or 2000 not in ids)
    clean = {r["doc_id"]: r["text"] for r in seen["pii"]}
    assert set(clean) == set(ids) and "me@x.org" not in clean[3000] and "[EMAIL]" in clean[3000] and clean[4000] is None
    words = lambda rows: sum(len(re.findall(r"\S+", r["text"] or "")) for r in rows)
    assert abs(words(seen["mixing"]) - words(seen["pii"])) <= 5 and {r["doc_id"] for r in seen["mixing"]} <= set(ids)
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["mixing"]}


def test_run_gives_the_last_stage(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "class"]


def test_registered_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
