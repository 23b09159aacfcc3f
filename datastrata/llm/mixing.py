"""Operator 1: mixing sources to target weights.

Capped water-filling. Every source has a weight, a size and a cap of
``max_epochs`` times its size. All sources share a budget by weight; a source
above its cap is clamped there and the excess goes to the others by weight,
until none is above. With ``f(x) = sum(min(cap, weight * x))`` the answer is
the level ``x`` with ``f(x) = budget``. ``f`` is concave and piecewise linear, so
with the sources ordered by ``cap / weight`` the level is the largest of the
levels that each line of ``f`` gives; this needs two running sums over the
source table and no iteration. The sums are of integers, so results do not
depend on the order of addition.

Sampling. The words that a source may give are its target, rounded. They hold
``whole`` full repetitions of every document and a remainder. The remainder is
taken from the documents in a seeded order (the md5 of seed and doc_id): full
documents until the remainder is used up, the last one in part. So a source
gives its target to the word, and no document more than ``max_epochs`` times
its size.

Skew. A source's seeded order is cut at one place: what comes before is taken in full, what comes after is not.
So a row per source is all that the documents need, and their texts are only mapped, never shuffled. The place is found in two steps. Documents fall
into 4,096 buckets by the first three hex digits of their md5, bucket sizes are
aggregated with partial sums, and a running sum over a source's buckets finds the one with the cut; then a running sum over the
documents of that bucket alone finds the document. A source with a third of all rows is spread over 4,096 buckets. The table of
sources, with a row each, is summed up in one task; it is broadcast up to ``BROADCAST_SOURCES`` rows, else joined by source.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source
is a source of its own, last in order; a null doc_id is hashed as the empty string;
equal rows are independent documents, ties of md5 go by size, and of equal rows at the cut some are taken in full, one in part;
an empty table gives an empty result. Extra columns stay, under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from datastrata.llm.common import SPACE_CLASS, WORD_CLASS, n_words, table, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
BROADCAST_SOURCES = 200_000


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0
) -> DataFrame:
    """``(source, source_size)`` -> the same with ``weight, target, budget, whole, rest``.

    ``budget`` is the target in whole words, ``whole`` the full repetitions and
    ``rest`` the words beyond those. The table has a row per source, so its
    windows run over as many rows as there are sources.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(
        F.array(*[F.lit(int(x)) for x in weights]),
        ((F.row_number().over(by_name) - 1) % F.lit(len(weights)) + 1).cast("int"),
    ).cast("long")
    d = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_epochs)
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1
    )
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    budget = total if share == 1.0 else F.floor(total * share)
    d = (
        d.withColumn("_all", budget)
        .withColumn("_w", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_num", F.col("_all") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("_level", F.col("_num") / F.col("_w"))
        .withColumn("_level", F.max("_level").over(everything))
    )
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("_level"))
    d = d.withColumn("target", F.greatest(F.coalesce(target, F.lit(0.0)), F.lit(0.0)))
    d = d.withColumn("budget", F.least(F.floor(F.col("target") + 0.5), F.col("cap")))
    size = F.col("source_size")
    return d.select(
        "source",
        "source_size",
        "weight",
        "target",
        "budget",
        F.when(size > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long").alias("whole"),
        F.when(size > 0, F.expr("budget % source_size")).otherwise(F.lit(0)).cast("long").alias("rest"),
    )


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    share: float = 1.0,
    seed: str = SEED,
) -> DataFrame:
    """Every row of ``docs`` as ``struct doc`` with ``size, source_size, target, taken``."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_source"),
        (n_words(F.col("text")) if size is None else size).alias("size"),
        key.alias("_key"),
    ).withColumn("_bucket", F.substring("_key", 1, 3))
    cuts = _cuts(d, weights, max_epochs, share)
    near = F.broadcast(cuts) if cuts.measured["n"] <= BROADCAST_SOURCES else cuts
    d = d.join(near, F.col("_source").eqNullSafe(F.col("source")))
    equal = (F.col("_key") == F.col("cut_key")) & (F.col("size") == F.col("cut_size"))
    # The place of a row among the equal ones at the cut: of one there is nothing to ask.
    placed = d.withColumn("_i", F.lit(1))
    if (cuts.measured["most"] or 0) > 1:
        twice = equal & (F.col("equals") > 1)
        tie = F.row_number().over(W.partitionBy("_source", "_key", "size").orderBy(F.xxhash64("doc.text")))
        placed = placed.where(~F.coalesce(twice, F.lit(False))).unionAll(d.where(twice).withColumn("_i", tie))
    zero = F.lit(0)
    extra = (
        F.when(F.col("cut_key").isNull(), zero)
        .when(equal, F.when(F.col("_i") <= F.col("full"), F.col("size")).when(F.col("_i") == F.col("full") + 1, F.col("partly")).otherwise(zero))
        .when((F.col("_key") < F.col("cut_key")) | ((F.col("_key") == F.col("cut_key")) & (F.col("size") < F.col("cut_size"))), F.col("size"))
        .otherwise(zero)
    )
    return placed.withColumn("extra", extra.cast("long")).select(
        "doc", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    )


def _cuts(d: DataFrame, weights: tuple[int, ...], max_epochs: int, share: float) -> DataFrame:
    """A row per source: its plan, and where the rest of its words ends: at the documents ``(cut_key, cut_size)``, of which there are
    ``equals``; ``full`` of them are taken in full, and one ``partly``."""
    d = d.select("_source", "_id", "_key", "_bucket", "size")
    buckets = written(d.groupBy("_source", "_bucket").agg(F.sum("size").alias("_in")), "mix-buckets")
    sizes = buckets.groupBy(F.col("_source").alias("source")).agg(F.sum("_in").alias("source_size"))
    plan = source_targets(sizes, weights, max_epochs, share)
    before = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.withColumn("_start", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    cut = (
        plan.join(starts, F.col("source").eqNullSafe(F.col("_source")))
        .where((F.col("_start") <= F.col("rest")) & (F.col("rest") < F.col("_start") + F.col("_in")))
        .select("source", F.col("_bucket").alias("bucket"), (F.col("rest") - F.col("_start")).alias("left"))
    )
    cut = written(cut, "mix-cuts", n=F.count(F.lit(1)))
    near = F.broadcast(cut) if cut.measured["n"] <= BROADCAST_SOURCES else cut
    inside = d.join(near, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_bucket") == F.col("bucket")))
    groups = inside.groupBy("source", "left", "_key", "size").agg(F.count("*").alias("equals"))
    order = W.partitionBy("source").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("_at", F.col("left") - F.coalesce(F.sum(F.col("size") * F.col("equals")).over(order), F.lit(0)))
    at = groups.where((F.col("_at") >= 0) & (F.col("_at") < F.col("size") * F.col("equals"))).select(
        F.col("source").alias("_s"),
        F.col("_key").alias("cut_key"),
        F.col("size").alias("cut_size"),
        "equals",
        F.expr("_at div size").alias("full"),
        F.expr("_at % size").alias("partly"),
    )
    found = plan.join(at, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "weight", "budget", "rest")
    return written(found, "mix-plan", n=F.count(F.lit(1)), most=F.max("equals"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is
    taken whole, and the one partly taken document of a source cut to its words."""
    m = mix(docs, **options)
    part = F.when(
        F.col("extra") < F.col("size"),
        F.array_join(
            F.slice(F.filter(F.split(F.col("doc.text"), SPACE_CLASS), lambda w: w != ""), F.lit(1), F.col("extra").cast("int")),
            " ",
        ),
    ).otherwise(F.col("doc.text"))
    rows = m.withColumn("_n", (F.col("whole") + (F.col("extra") > 0).cast("long")).cast("int")).where("_n > 0")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    text = F.when(F.col("_i") <= F.col("whole"), F.col("doc.text")).otherwise(part)
    return rows.select(*[(text if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    m = mix(docs, size=F.col("size"))
    return m.select("doc.doc_id", "size", "source_size", "target", "taken")


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD_CLASS}')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight,
         3 * source_size AS cap FROM s),
o AS (
  SELECT *, CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT) AS cap_before,
         CAST(coalesce(sum(weight) OVER b, 0) AS BIGINT) AS weight_before
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT CAST(sum(source_size) AS BIGINT) AS total, CAST(sum(weight) AS BIGINT) AS weights FROM w),
l AS (SELECT max(CAST(total - cap_before AS DOUBLE) / (weights - weight_before)) AS level FROM o, a),
t AS (
  SELECT source, source_size, cap, greatest(least(CAST(cap AS DOUBLE), weight * level), 0.0) AS target FROM w, l),
p AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), cap) AS budget FROM t),
c AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         CAST((budget // source_size) * size + least(greatest(budget % source_size - before, 0), size) AS BIGINT)
       END AS taken
FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
"""
