"""The corpus pipeline, stage by stage."""

import pytest

import corpus_pipeline
from tests.llm.test_operators import AWKWARD, EXTRA, prose
from tillworks.llm import order_minhash, queries

FOLDER = "/root/testdata/sf0.001"
#: Awkward rows under columns named like inner ones, beside those of `documents`.
WIDE = f"{EXTRA}, lang string, source string, n_chars int, k1 long, bands string, part string"


def test_stages_follow_each_other(spark, tmp_path):
    docs = queries.table(spark, FOLDER, "documents")
    columns, rows = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        assert docs.count() <= rows
        if name == "near_duplicates":
            want = order_minhash.near_duplicates(before).select("class_id").distinct().count()
            assert docs.count() == want
        if name == "repeated_passages":
            assert docs.count() == rows
        rows = docs.count()
    assert 0 < rows < 200
    same = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, same.select("doc_id", "n_tokens").collect())) == sorted(
        map(tuple, docs.select("doc_id", "n_tokens").collect()))


def wide(spark, rows):
    return spark.createDataFrame([(d, t, 9, "id", 8, "s", 7, 6, "k", None, "web", None if t is None else len(t), 5, "b", "p")
                                  for d, t in rows], WIDE)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_takes_awkward_rows_and_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    passage = prose(5, 60)
    rows = [*AWKWARD, (20, f"{prose(6)} {passage}"), (21, f"{passage} {prose(7)}"), (22, prose(8)), (23, prose(8))]
    docs = wide(spark, rows)
    got = stage(spark, docs, FOLDER)
    found = got.collect()
    if name == "sentencepiece":
        assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and len(found) == len(rows)
        assert [r.n_tokens for r in found if r.doc_id == 3] == [0] and sorted(r.n_tokens for r in found)[:3] == [0, 0, 0]
        return
    assert got.schema == docs.schema
    assert {(r.row, r.id, r.chunk, r.k1, r.bands, r.part, r.source) for r in found} == {(9, "id", 8, 5, "b", "p", "web")}
    ids = [r.doc_id for r in found]
    if name == "near_duplicates":
        # empty texts are one class; a blank text has no words and stands alone, as no text equals it
        assert sorted(ids, key=lambda d: (d is None, d)) == [1, 1, 2, 4, 5, 6, 7, 8, 20, 21, 22, None]
    elif name == "repeated_passages":
        texts = {r.doc_id: r.text for r in found}
        assert len(found) == len(rows) and texts[23] == texts[22] == "" and texts[20].startswith(prose(6))
        assert passage[1:-1] not in texts[20] and passage[1:-1] not in texts[21] and texts[5] == dict(AWKWARD)[5]
        assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in found)
    else:
        assert len(found) == len(rows)


def test_stages_take_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        docs = wide(spark, [])
        got = stage(spark, docs, FOLDER)
        assert got.count() == 0 and (name == "sentencepiece" or got.schema == docs.schema)


def test_stage_called_on_an_unwritten_result_keeps_its_input(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = wide(spark, [(20, prose(6)), (21, f"{prose(6)} {prose(7)}"), (22, prose(8)), (23, prose(8))])
    kept = stages["near_duplicates"](spark, docs, FOLDER)
    cut = stages["repeated_passages"](spark, kept, FOLDER)
    assert sorted(r.doc_id for r in stages["decontamination"](spark, cut, FOLDER).collect()) == [20, 21, 22]
