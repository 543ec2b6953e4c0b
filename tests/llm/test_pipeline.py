"""The pipeline against a plain version of each stage on the smallest tables."""

import importlib.util

import pytest

from sitelode.llm import jaccard_join
from sitelode.llm.common import table

DATA = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None
pytestmark = pytest.mark.skipif(corpus_pipeline is None, reason="no pipeline here")


def test_stages_keep_columns_and_take_effect(spark):
    from test_operators import plain_dedup, plain_groups

    docs = table(spark, DATA, "documents").cache()
    told = corpus_pipeline.language(spark, docs, DATA).cache()
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in told.collect()} == {i for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    lines = corpus_pipeline.lines(spark, told, DATA).cache()
    held = sorted((r.doc_id, r.text) for r in told.collect())
    assert {r.doc_id: r.text for r in lines.collect()} == dict(zip([i for i, _ in held], plain_dedup([t for _, t in held], 10), strict=True))
    single = corpus_pipeline.near_copies(spark, lines, DATA).cache()
    held = sorted((r.doc_id, r.text) for r in lines.collect())
    want, _ = plain_groups([t for _, t in held])
    assert sorted(r.doc_id for r in single.collect()) == sorted(held[i][0] for i in set(want))
    clean = corpus_pipeline.personal_data(spark, single, DATA).cache()
    assert all("@mail" not in (r.text or "") and r.n_chars == len(r.text) for r in clean.collect())
    for stage in (told, lines, single, clean):
        assert stage.schema.names == docs.schema.names and [f.dataType for f in stage.schema] == [f.dataType for f in docs.schema]
    packed = corpus_pipeline.pack(spark, clean, DATA)
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_texts_of_unlearned_scripts_go(spark):
    texts = ["stone river walks under bright moon"] * 20 + ["шила море", "日本語", "море stone", None, "12"]
    rows = [(i, t, "en" if i < 20 else None) for i, t in enumerate(texts)]
    told = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), DATA)
    assert {r.doc_id for r in told.collect()} == {*range(20), 22}


def test_whole_run(spark):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, DATA).count() > 0
    assert jaccard_join.required(4, 4) == 4
