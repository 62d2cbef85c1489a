"""Exact deduplication by skew-safe combining: locally, by salted digest groups, then over the salts' winners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, SPACE, Scratch, documents, fresh, row_key, salted


def exact_groups(docs: DataFrame, text: str = "text", id_: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as empty. The
    smallest id of a group stays. The whole text is a grouping key at every stage: Spark's partial aggregation
    compares it within a partition, then digest groups dealt over `salts` compare it, then the winners of the
    salts. So a group that holds a third of all rows reaches no task as more than `salts` rows a partition.
    Only digests travel back to the rows, joined by digest and salt, so the way back is as even.

    Null ids count in group_size but never stay while a row of the group has an id; a group of null ids alone
    has a null keep_id and kept is false. Rows that repeat an id and its text share kept. Other columns are
    ignored, whatever they are called. No rows in, no rows out.
    """
    rows = docs.select(F.col(id_).alias("id"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ").alias("norm"))
    rows = rows.select("id", "norm", F.sha2("norm", 256).alias("digest"), F.length("norm").alias("long"), salted("id", salts).alias("salt"))
    key = ["digest", "long"]
    dealt = rows.groupBy(*key, "norm", "salt").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    whole = dealt.groupBy(*key, "norm").agg(
        F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.expr("bit_or(shiftleft(1L, salt))").alias("salts")
    )
    winners = whole.select(*key, "keep_id", "group_size", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (salts & shiftleft(1L, s)) <> 0)")).alias("salt"))
    found = rows.select("id", *key, "salt").join(winners, [*key, "salt"])
    return found.select(F.col("id").alias(id_), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat an id and its text, one.

    An id with several texts stays with those whose group it leads. Of a group without any id, one row stays. The
    rows meet the list of what stays by id and digest; of equal ones one is taken where they have met already.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    (own,) = fresh(docs, "own")
    leads = F.col(id_).eqNullSafe(F.col("keep_id"))
    kept = exact_groups(docs, text, id_).where(leads).select(row_key(F.col(id_), F.col("text_sha256")).alias(own)).distinct()
    kept = scratch.write(kept, "kept")
    scratch.drop()  # the groups' texts need not lie on disk any longer
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " "), 256)
    met = docs.withColumn(own, row_key(F.col(id_), digest)).join(kept, own, "left_semi")
    return met.dropDuplicates([own]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  coalesce(doc_id = min(doc_id) OVER w, false) AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
