"""Temperature mixing of sources by DataFrame operations alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents, fresh

#: Share of the largest possible entropy that the mix should not exceed, times that a source may be repeated.
ENTROPY, REPETITION = 0.95, 2.0
STEPS, SEED = 50, 17
#: Exponents tried at once: 31 between the ends, which is five steps of a bisection.
FORKS = 32
#: Rows of the table of weights that may be broadcast; a larger one is joined by source and salt.
BROADCAST_ROWS = 100_000
#: Blocks of a permutation have 3 hexadecimal digits of the permutation's key; so many rows lead to one more level of them.
DIGITS, FAN = 3, 4096


def source_weights(sources: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repetition: float = REPETITION) -> DataFrame:
    """sources(source, tokens) plus exponent, weight (9 decimals) and budget: the tokens to take.

    Weights are the token shares to the power of the exponent, normalised. The exponent is the smallest in [0, 1],
    found by bisection, with an entropy of at most `entropy` times the logarithm of the number of sources and with no source taken more
    than `repetition` times; 1 if none is. budget: all tokens unless given. Sources without tokens get nothing.

    There may be any number of sources: of equally large ones one row a size is kept, and the sums that the bisection needs are aggregations,
    for 31 exponents at a time; the driver sees the sums alone.
    """
    own = sources.where("tokens > 0")
    total, n, least = own.agg(F.sum("tokens"), F.count("*"), F.min("tokens")).first()
    whole = total if budget is None else budget
    if not n:
        return own.select("source", "tokens", F.lit(1.0).alias("exponent"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    sizes = own.groupBy((F.col("tokens") / F.lit(total)).alias("p")).agg(F.count("*").cast("double").alias("n"))

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent the sum of the shares' powers, and that of the powers times the shares' logarithms."""
        power = [F.pow("p", F.lit(a)) * F.col("n") for a in exponents]
        row = sizes.agg(*[F.sum(x).alias(f"z{k}") for k, x in enumerate(power)], *[F.sum(x * F.ln("p")).alias(f"l{k}") for k, x in enumerate(power)]).first()
        return [(row[f"z{k}"], row[f"l{k}"]) for k in range(len(exponents))]

    low, high = 0.0, 1.0
    for _ in range(STEPS // 5):
        tried = [low + (high - low) * k / FORKS for k in range(1, FORKS)]
        fits = [math.log(z) - a * lz / z <= entropy * math.log(n) and (least / total) ** (a - 1) / z * whole / total <= repetition for a, (z, lz) in zip(tried, sums(tried))]
        first = fits.index(True) if True in fits else FORKS - 1
        low, high = [low, *tried][first], [*tried, high][first]
    ((z, _),) = sums([high])
    weighed = own.select("source", "tokens", F.lit(high).alias("exponent"), F.round(F.pow(F.col("tokens") / F.lit(total), F.lit(high)) / F.lit(z), 9).alias("weight"))
    return weighed.withColumn("budget", F.floor(F.col("weight") * F.lit(whole)).cast("long"))


def _drawn(docs: DataFrame, text: str, source: str, id_: str, budget: int | None = None, entropy: float = ENTROPY, repetition: float = REPETITION, seed: int = SEED) -> DataFrame:
    """What mix_sources() returns, with id for the id and mark, a hash of the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(F.col(id_).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))
    rows = scratch.write(rows, "rows")
    sources = scratch.write(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    largest = sources.agg(F.max("docs")).first()[0]
    weights = source_weights(sources.select("source", "tokens"), budget, entropy, repetition).where("budget > 0")
    weights = weights.withColumn("epoch", F.explode(F.expr("sequence(0L, (budget - 1) div tokens)"))).withColumn("take", F.expr("least(tokens, budget - epoch * tokens)"))
    weights = scratch.write(weights.select("source", "epoch", "take", "weight"), "weights")
    drawn = rows.join(F.broadcast(weights) if weights.count() <= BROADCAST_ROWS else weights, "source")  # else a hot source is split at run time
    drawn = drawn.withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    levels = 1
    while (largest or 0) > FAN ** (levels + 1):
        levels += 1
    block = [f"b{i}" for i in range(levels)]
    for i, b in enumerate(block):
        drawn = drawn.withColumn(b, F.substring("key", 1 + DIGITS * i, DIGITS))
    group = ["source", "epoch"]
    sums = drawn.groupBy(*group, *block).agg(F.sum("n_tokens").alias("t"))
    before = F.lit(0).cast("long")
    for i in range(levels):
        level = sums.groupBy(*group, *block[: i + 1]).agg(F.sum("t").alias("t"))
        earlier = Window.partitionBy(*group, *block[:i]).orderBy(block[i]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn(f"at{i}", F.coalesce(F.sum("t").over(earlier), F.lit(0))).drop("t")
        drawn = drawn.join(level, [*group, *block[: i + 1]])
        before = before + F.col(f"at{i}")
    within = Window.partitionBy(*group, *block).orderBy("key", "id", "n_tokens", "mark").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("start", before + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where("start < take")
    return drawn.select("id", "mark", "source", F.col("epoch").cast("int").alias("epoch"), F.conv(F.concat(*block), 16, 10).cast("long").alias("block"), "start", "n_tokens", "weight")


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", id_: str = "doc_id", budget: int | None = None,
                entropy: float = ENTROPY, repetition: float = REPETITION, seed: int = SEED) -> DataFrame:
    """The drawn rows: id, source, epoch, block, start, n_tokens, weight.

    A source's budget is taken as whole permutations of its documents (epochs 0, 1, ...) and a last, partial one,
    of which the documents that begin before the budget's end are taken. A permutation sorts by a hash of seed,
    epoch and id; its blocks are the leading digits of the hash, permuted by it as their rows are. start is the
    token at which a row begins within its source's epoch: blocks are summed, the sums added up over at
    most 4096 blocks at a time (with a second level of blocks for sources of over 16 million rows), and rows added up
    within their block. So no source, however large, is sorted in one task.

    Null text has no tokens, a null source is the source '', a null id sorts as ''. Rows that repeat an id are drawn
    each. Tokens are words. Other columns are ignored. No rows in, no rows out.
    """
    return _drawn(docs, text, source, id_, budget, entropy, repetition, seed).drop("mark").withColumnRenamed("id", id_)


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", id_: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that are drawn, with all their columns, as often as they are drawn.

    Rows are told apart by id, source and text; those equal in all three are drawn together.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    name, mark, from_, epoch, own, of = fresh(docs, "id", "mark", "from", "epoch", "own", "of")
    drawn = _drawn(docs, text, source, id_, **how).select(F.col("id").alias(name), F.col("mark").alias(mark), F.col("source").alias(from_), F.col("epoch").alias(epoch))
    drawn = scratch.write(drawn.distinct(), "drawn")
    scratch.drop()
    whole = docs.withColumns({own: F.xxhash64(F.col(text).cast("string")), of: F.coalesce(F.col(source).cast("string"), F.lit(""))})
    met = whole.join(drawn, F.col(id_).eqNullSafe(F.col(name)) & (F.col(own) == F.col(mark)) & (F.col(of) == F.col(from_)))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def sql(table: str = "documents") -> str:
    """The same in DuckDB SQL."""
    z = "list_sum(list_transform(p, lambda x: pow(x, {a})))"
    fits = (
        f"(ln({z}) - {{a}} * list_sum(list_transform(p, lambda x: pow(x, {{a}}) * ln(x))) / {z} <= {ENTROPY} * ln(len(p))"
        f" AND list_max(list_transform(p, lambda x: pow(x, {{a}} - 1))) / {z} <= {REPETITION})"
    ).format(a="((lo + hi) / 2)")
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens FROM {table}),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
one AS (SELECT list(tokens / total ORDER BY source) AS p, any_value(total) AS total FROM (SELECT *, CAST(sum(tokens) OVER () AS BIGINT) AS total FROM s)),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN {fits} THEN lo ELSE (lo + hi) / 2 END, CASE WHEN {fits} THEN (lo + hi) / 2 ELSE hi END FROM b, one WHERE i < {STEPS}),
w AS (SELECT source, tokens, round(pow(tokens / total, hi) / list_sum(list_transform(p, lambda x: pow(x, hi))), 9) AS weight, total FROM s, one, b WHERE i = {STEPS}),
e AS (SELECT source, tokens, weight, CAST(floor(weight * total) AS BIGINT) AS budget FROM w),
r AS (SELECT *, unnest(range(0, (budget - 1) // tokens + 1)) AS epoch FROM e WHERE budget > 0),
k AS (SELECT d.doc_id, d.source, r.epoch, d.n_tokens, r.weight, least(r.tokens, r.budget - r.epoch * r.tokens) AS take,
  md5(concat_ws('|', '{SEED}', r.epoch::VARCHAR, coalesce(d.doc_id::VARCHAR, ''))) AS key FROM d JOIN r USING (source)),
c AS (SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, ('0x' || substr(key, 1, {DIGITS}))::BIGINT AS block, start, n_tokens, weight FROM c WHERE start < take
"""
