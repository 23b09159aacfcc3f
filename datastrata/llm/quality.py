"""Operator 5: quality rules with cross-document line frequency.

DataFrame functions only. One pass over the texts computes the rules of
single documents and hashes the normalised lines; it is written to the shared folder, without
texts, and the rest works on it.

Line frequency: lines of a word or more, of any length, lower-cased, white space collapsed.
Equal texts of a host (the source) count as one document, so copies do not make
their own lines frequent. A line is boilerplate if it is in more than ``MIN_DOCS`` distinct
documents of its host and in more than ``SHARE`` of them. Such lines are removed. A document is depleted, and
rejected, if fewer than ``MIN_WORDS`` of its words are left. The report counts the words that are left; the
filter returns the texts without the removed lines.

Frequencies are counted by partial aggregation on (host, line), over rows that
are distinct by document; a hot host or line is one partial row from each task.

Repeated words: the 8-word windows of a text are hashed in three doubling steps; the
positions of windows that occur twice are sorted, and the words that they cover counted.

Defined cases: a null or empty text has no words and fails; a null source is a host of its
own; a null doc_id is kept; equal rows get equal results; an empty table gives no row; other
columns are kept by the filter and ignored by the report. A text that loses no line is returned as it is; of one
that does, the other lines stay in order, and ``n_chars``, if there is such a column, is counted anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.llm.common import SPACE_CLASS, WORD_CLASS, free, table, words, written

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
MIN_DOCS = 10
SHARE = 0.005


def _shift(hashes: str, by: int) -> Column:
    """Each hash combined with the one ``by`` places on; those without one are rubbish."""
    rest = F.slice(F.col(hashes), F.lit(by + 1), F.greatest(F.size(hashes) - by, F.lit(0)))
    return F.zip_with(F.col(hashes), rest, lambda a, b: F.xxhash64(a, b))


def _normal_words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), SPACE_CLASS), lambda w: w != "")


def base_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with its single-document rules and its lines, in columns that begin with ``q_``."""
    d = docs.withColumn("q_text", F.coalesce("text", F.lit("")))
    d = d.withColumn("q_words", words(F.col("text")))
    d = d.withColumn("q_lines", F.filter(F.split("q_text", "\n"), lambda x: x.rlike(WORD_CLASS)))
    d = d.withColumn("q_h1", F.transform("q_words", lambda w: F.xxhash64(w)))
    d = d.withColumn("q_h2", _shift("q_h1", 1))
    d = d.withColumn("q_h4", _shift("q_h2", 2))
    n = F.size("q_words")
    d = d.withColumn("q_h8", F.slice(_shift("q_h4", 4), F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))))
    twice = F.size(F.array_distinct("q_h8")) < F.size("q_h8")
    d = d.withColumn(
        "q_sorted",
        F.when(twice, F.array_sort(F.transform("q_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda x, k, by: x["h"] == F.get("q_sorted", k + by)["h"]
    d = d.withColumn(
        "q_at",
        F.array_sort(
            F.transform(
                F.filter("q_sorted", lambda x, k: F.coalesce(same(x, k, -1), F.lit(False)) | F.coalesce(same(x, k, 1), F.lit(False))),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        "q_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["to"], i)).alias("n"), (i + WINDOW).alias("to")),
        lambda a: a["n"],
    )
    line = lambda w: F.struct(
        F.xxhash64(F.array_join(w, " ")).alias("l1"),
        F.xxhash64(F.lit(1), F.array_join(w, " ")).alias("l2"),
        F.size(w).alias("n"),
    )
    return d.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.xxhash64("q_text").alias("q_t1"),
        F.xxhash64(F.lit(1), F.col("q_text")).alias("q_t2"),
        n.cast("long").alias("q_n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("q_word_chars"),
        F.regexp_count("q_text", F.lit("[#*$%&|<>]")).cast("long").alias("q_n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("q_n_repeat_words"),
        F.transform(F.transform("q_lines", _normal_words), line).alias("q_line_hashes"),
    ).withColumn(
        "q_base_failed",
        (F.col("q_n_words") < MIN_WORDS) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * REPEAT_PERCENT),
    )


def boilerplate(scored: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """``(b_source, b_t1, b_t2, b_removed, b_lines)``: of each text that has boilerplate lines, their words and hashes."""
    keys = ["source", "q_t1", "q_t2"]
    texts = scored.select(*keys, "q_line_hashes").dropDuplicates(keys)
    hosts = texts.groupBy(F.col("source").alias("h_source")).agg(F.count("*").alias("h_docs"))
    lines = (
        texts.select(*keys, F.explode("q_line_hashes").alias("x"))
        .select(*keys, "x.l1", "x.l2", F.col("x.n").alias("n"))
        .groupBy(*keys, "l1", "l2")
        .agg(F.sum("n").alias("n"))
    )
    frequent = (
        lines.groupBy(F.col("source").alias("f_source"), F.col("l1").alias("f_l1"), F.col("l2").alias("f_l2"))
        .agg(F.count("*").alias("f_docs"))
        .where(F.col("f_docs") > min_docs)
        .join(hosts, F.col("f_source").eqNullSafe(F.col("h_source")))
        .where(F.col("f_docs") > F.col("h_docs") * share)
    )
    hit = lines.join(
        frequent,
        F.col("source").eqNullSafe(F.col("f_source")) & (F.col("l1") == F.col("f_l1")) & (F.col("l2") == F.col("f_l2")),
        "left_semi",
    )
    return hit.groupBy(*[F.col(k).alias(f"b_{k.removeprefix('q_')}") for k in keys]).agg(
        F.sum("n").alias("b_removed"), F.collect_list(F.struct("l1", "l2")).alias("b_lines")
    )


def _is() -> Column:
    return F.col("source").eqNullSafe(F.col("b_source")) & (F.col("q_t1") == F.col("b_t1")) & (F.col("q_t2") == F.col("b_t2"))


def _depleted() -> Column:
    return F.coalesce(F.col("q_n_words") - F.col("b_removed") < MIN_WORDS, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    scored = written(base_metrics(docs.select("doc_id", "source", "text")).drop("text"), "quality")
    return scored.join(boilerplate(scored).drop("b_lines"), _is(), "left").select(
        "doc_id",
        F.col("q_n_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"),
        F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"),
        F.col("q_base_failed").alias("base_failed"),
        (~F.col("q_base_failed") & ~_depleted()).alias("kept"),
        (F.col("q_n_words") - F.coalesce("b_removed", F.lit(0))).cast("long").alias("n_left"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected ones and without the lines that are above the limits, all columns as they are."""
    # Frequencies are over all documents, failed ones too, as in the report.
    scored = written(base_metrics(docs.select("source", "text")).drop("text"), "quality-scores")
    found = scored.select("source", "q_t1", "q_t2", "q_n_words", "q_base_failed").dropDuplicates(["source", "q_t1", "q_t2"])
    found = found.join(boilerplate(scored), _is(), "left").where(F.col("q_base_failed") | F.col("b_removed").isNotNull())
    found = written(
        found.select(
            F.col("source").alias("b_source"), F.col("q_t1").alias("b_t1"), F.col("q_t2").alias("b_t2"),
            (F.col("q_base_failed") | _depleted()).alias("b_gone"),
            F.when(~F.col("q_base_failed") & ~_depleted(), F.col("b_lines")).alias("b_lines"),
        ),
        "quality-found",
    )
    free(scored)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "source", F.coalesce("text", F.lit("")).alias("q_text"))
    keyed = packed.withColumn("q_t1", F.xxhash64("q_text")).withColumn("q_t2", F.xxhash64(F.lit(1), F.col("q_text")))
    kept = keyed.join(found, _is(), "left").where(~F.coalesce("b_gone", F.lit(False)))

    def stays(line: Column) -> Column:
        key = F.array_join(_normal_words(line), " ")
        return ~F.array_contains("b_lines", F.struct(F.xxhash64(key).alias("l1"), F.xxhash64(F.lit(1), key).alias("l2")))

    rest = F.array_join(F.filter(F.split("q_text", "\n"), stays), "\n")
    kept = kept.select("doc", F.when(F.col("b_lines").isNotNull(), rest).alias("rest"))
    new = {"text": F.col("rest"), "n_chars": F.length("rest")}
    types = dict(docs.dtypes)
    return kept.select(
        *[
            (F.when(F.col("rest").isNotNull(), new[c].cast(types[c])).otherwise(F.col(f"doc.`{c}`")) if c in new else F.col(f"doc.`{c}`")).alias(c)
            for c in docs.columns
        ]
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}') AS w FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i : i + 7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM rep, unnest(range(i, i + 8)) AS u(j) GROUP BY r),
ln AS (SELECT r, l FROM d, unnest(string_split(t, chr(10))) AS u(l) WHERE regexp_matches(l, '{WORD_CLASS}')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY r),
m AS (
  SELECT d.r, doc_id, source, t, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov ON d.r = cov.r LEFT JOIN dup ON d.r = dup.r),
nl AS (
  SELECT DISTINCT source, t, norm, n, c FROM (
    SELECT m.r, source, t, norm, any_value(len(lw)) AS n, count(*) AS c FROM (
      SELECT r, regexp_extract_all(lower(l), '{WORD_CLASS}') AS lw, array_to_string(regexp_extract_all(lower(l), '{WORD_CLASS}'), ' ') AS norm FROM ln
    ) x JOIN m ON x.r = m.r GROUP BY m.r, source, t, norm)),
hosts AS (SELECT source, count(DISTINCT t) AS docs FROM m GROUP BY source),
freq AS (
  SELECT nl.source, norm FROM nl JOIN hosts ON nl.source IS NOT DISTINCT FROM hosts.source
  GROUP BY nl.source, norm, docs HAVING count(*) > {MIN_DOCS} AND count(*) > docs * CAST({SHARE} AS DOUBLE)),
gone AS (
  SELECT nl.source, nl.t, sum(n * c) AS removed FROM nl JOIN freq ON nl.source IS NOT DISTINCT FROM freq.source AND nl.norm = freq.norm
  GROUP BY nl.source, nl.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - coalesce(removed, 0) >= 20 AS kept,
       CAST(n_words - coalesce(removed, 0) AS BIGINT) AS n_left
FROM m LEFT JOIN gone ON m.source IS NOT DISTINCT FROM gone.source AND m.t = gone.t
"""
