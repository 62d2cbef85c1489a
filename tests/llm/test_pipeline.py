"""The pipeline's stages against plain versions of what each should leave."""

import re

import pytest

import corpus_pipeline
from labelcube.llm import simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before each stage, and the result."""
    out, frames = tmp_path_factory.mktemp("stages"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SF).write.parquet(f"{out}/{name}")
        frames.append(spark.read.parquet(f"{out}/{name}"))
    return frames


def test_all_but_the_last_keep_the_columns(stages):
    for frame in stages[1:-1]:
        assert frame.schema.simpleString() == stages[0].schema.simpleString()


def test_quality_drops_what_is_labelled_bad(spark, stages):
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    left = {r["doc_id"] for r in stages[1].collect()}
    assert len(left & good) >= 0.97 * len(good) and len(left & bad) <= 0.2 * len(bad)


def test_exact_copies_go(stages):
    first = {}
    for r in stages[1].collect():
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
        first[t] = min(first.get(t, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(first.values())


def test_near_copies_go(stages):
    rows = sorted((r["doc_id"], simhash.fingerprint(r["text"].encode())) for r in stages[2].collect())
    label = {i: i for i, _ in rows}
    linked = [(i, j) for i, a in rows for j, b in rows if i < j and (a ^ b).bit_count() <= 3]
    before = None
    while before != label:  # until every document has the least of its component
        before = dict(label)
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i in label if label[i] == i}


def test_mixing_draws_whole_documents(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = stages[4].collect()
    assert after and all(before[r["doc_id"]] == r["text"] for r in after)


def test_packing_holds_every_drawn_document(stages):
    pieces = stages[5].toPandas()
    assert sorted(pieces[pieces.piece == 0].doc_id) == sorted(r["doc_id"] for r in stages[4].collect())
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 2048


def test_run_is_the_stages_in_turn(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1].count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixing", "packing"]
