"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelcube.llm import exact_dedup, html, media, mixing, packing, pitman_yor, quality, simhash, substring, toxicity

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["id", "mark", "fp", "salt", "own", "sha", "key", "kept", "epoch", "__id", "__stay", "__own", "__quality_text", "_id", "of", "from", "lead", "block", "piece_key", "length", "n_tokens", "doc"]
ROWS = [(1, "one two three four five"), (2, "one  two three\tfour five"), (3, None), (4, ""), (5, " \n"), (None, "only without id"), (None, "only without id"), (None, None), (6, "same id"), (6, "other text of it"), (7, "same row"), (7, "same row"), (8, "long " * 40_000), (9, "x" * 100_000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None if k % 2 else 5) for k, (i, t) in enumerate(ROWS)]
    frame = spark.createDataFrame(rows, SHAPE)
    return frame.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 0, 1), (6, 1, 0), (None, 1, 1), (8, None, 1), (9, 1, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact": lambda d, _: exact_dedup.exact_groups(d),
    "simhash": lambda d, _: simhash.near_duplicates(d),
    "html": lambda d, _: html.extract(d.withColumns({"page_id": F.col("doc_id"), "url": F.col("lang"), "html": F.col("text")})),
    "media": lambda d, _: media.stored_texts(d),
    "toxicity": lambda d, y: toxicity.score(d, toxicity.train(d, y)),
    "substring": lambda d, _: substring.removals(d),
    "quality": lambda d, y: quality.score(d, quality.co_train(d, y)),
    "pitman_yor": lambda d, _: pitman_yor.scores(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_give_a_row_for_each_row(name, odd, labels):
    assert OPERATORS[name](odd, labels).count() == len(ROWS)
    assert OPERATORS[name](odd.limit(0), labels).count() == 0


def test_mixing_and_packing_take_odd_rows(odd):
    drawn = mixing.mix_sources(odd).toPandas()
    assert set(drawn.doc_id.dropna().astype(int)) <= {i for i, _ in ROWS if i}
    assert packing.packed(odd).where("piece = 0").count() == len(ROWS)
    assert mixing.mix_sources(odd.limit(0)).count() == packing.packed(odd.limit(0)).count() == 0


def rows_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def test_the_exact_stage_keeps_one_of_each_text(odd):
    want = [(1, ROWS[0][1]), (3, None), (5, " \n"), (6, "other text of it"), (6, "same id"), (7, "same row"), (8, "long " * 40_000), (9, "x" * 100_000), (None, "only without id")]
    got = exact_dedup.exact_dedup(odd)
    assert got.columns == odd.columns and rows_of(got) == sorted(want, key=repr)


def test_the_near_stage_keeps_one_of_each_group(odd):
    got = simhash.one_per_group(odd)
    left = rows_of(got)
    assert got.columns == odd.columns and len(left) == len(set(left))
    group = {(r["id"], r["mark"]): r["lead"] for r in simhash._labelled(odd, "text", "doc_id", 3).collect()}
    assert len(left) == len({(v["id"], v["mark"]) for v in group.values()})


def test_the_mixing_stage_tells_rows_apart(odd):
    got = mixing.mixed_rows(odd, repetition=1.0, entropy=2.0)
    assert got.columns == odd.columns and set(rows_of(got)) <= set(ROWS)


def test_the_quality_stage_keeps_columns(odd, labels):
    model = quality.co_train(odd, labels)
    got = quality.keep_good(odd, model)
    assert got.columns == odd.columns and set(rows_of(got)) <= set(ROWS)


@pytest.mark.parametrize("empty", [True, False])
def test_the_pipeline_takes_odd_tables(spark, odd, labels, tmp_path, empty):
    (odd.limit(0) if empty else odd).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert got.empty if empty else (got.length > 0).all()


def test_a_tie_of_many_sources_and_sizes(spark):
    frame = spark.createDataFrame([(k, "a b c", "en", f"s{k % 40}", 5) for k in range(80)], SHAPE)
    assert mixing.mix_sources(frame).groupBy("source").count().count() == 40
