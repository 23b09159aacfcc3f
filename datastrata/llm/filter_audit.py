"""Operator 13: which filters remove the same documents, and which remove what no other does.

A document's failures are a bit mask, one bit a filter. All but the last filter look at its text alone; the last one
fails exact copies of a document of smaller doc_id. Copies are found by an RDD routed by fingerprint:
a task first folds the equal texts among the rows it reads, so a group of copies sends one row a task however large it is;
those rows go by xxhash of the text to partitions sorted by it, where one fingerprint's chain is held at a time: each text in
full, with the smallest doc_id so far. A row that is not the minimum fails, as soon as a smaller one is seen.
``combineByKey`` then adds up the masks of each part as one vector of counts, from which every order of the
filters is worked out: what a filter removes depends only on the set of filters before it.

Memory: a task folds texts up to ``HELD_BYTES`` and then sends what it holds; a chain holds the distinct texts of one fingerprint.

Defined cases: a null text is an empty one, and so are they copies of each other; a null lang is the part ''; a null doc_id is neither
smaller nor greater than any, so such a row never fails as a copy; rows of equal doc_id are not copies of each other, but each
counts; a document with several labels counts once if any of them says so, one without labels never; without documents there is no part and no row;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.llm.common import WORD_CLASS, table

HELD_BYTES = 32 << 20
#: Bytes of text that a partition of the routed rows is meant for.
ROUTED_BYTES = 64 << 20
UPPER, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))


def is_short(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def repeats_words(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def shouts(text: bytes, words: list[bytes]) -> bool:
    capitals = len(text) - len(text.translate(None, UPPER))
    return 100 * capitals > 3 * len(text.translate(None, CONTINUATION))


def has_signs(text: bytes, words: list[bytes]) -> bool:
    return len(text.translate(None, SIGNS)) < len(text)


#: The filters on a text, in UTF-8 and as words, in order of their letters; copies have the letter after them.
RULES: tuple[Callable[[bytes, list[bytes]], bool], ...] = (is_short, repeats_words, shouts, has_signs)


def _fold(rules, held_bytes: int):
    """Rows ``(doc_id, text, part, fingerprint)`` to ``(key, (text, doc_id, mask, [(part, rows)]))``: a text's smallest doc_id of those
    held, keyed by fingerprint. What is known not to be the minimum goes without its text, under a key that spreads it."""

    def run(rows: Iterator) -> Iterator[tuple]:
        copy, held, size, k = 1 << len(rules), {}, 0, 0
        for doc, text, part, fingerprint in rows:
            known = held.get(text)
            if known is None:
                words = text.split()  # bytes are split at ASCII white space
                mask = sum(1 << i for i, fails in enumerate(rules) if fails(text, words))
                known = held[text] = [fingerprint, mask, None, {}]
                size += len(text) + 200
            k += 1
            _, mask, least, parts = known
            if doc is None:
                yield k, (None, None, mask, [(part, 1)])
            elif least is None or doc < least:
                if least is not None:
                    yield k, (None, least, mask | copy, list(parts.items()))
                known[2], known[3] = doc, {part: 1}
            elif doc == least:
                parts[part] = parts.get(part, 0) + 1
            else:
                yield k, (None, doc, mask | copy, [(part, 1)])
            if size > held_bytes:
                yield from _send(held)
                held, size = {}, 0
        yield from _send(held)

    return run


def _send(held: dict) -> Iterator[tuple]:
    return ((f, (text, doc, mask, list(parts.items()))) for text, (f, mask, doc, parts) in held.items() if doc is not None)


def _chains(copy: int):
    """Rows sorted by key to ``(doc_id, part, mask, rows)``: each text's rows that are not the minimum get the bit of copies."""

    def settle(doc, mask: int, parts: list) -> Iterator[tuple]:
        return ((doc, part, mask, n) for part, n in parts)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, chain = None, {}
        for key, (text, doc, mask, parts) in rows:
            if key != at:
                for least, m, held in chain.values():
                    yield from settle(least, m, held)
                at, chain = key, {}
            if text is None:
                yield from settle(doc, mask, parts)
                continue
            first = chain.get(text)
            if first is None:
                chain[text] = [doc, mask, parts]
            elif doc == first[0]:
                first[2] = first[2] + parts
            elif doc > first[0]:
                yield from settle(doc, mask | copy, parts)
            else:
                yield from settle(first[0], mask | copy, first[2])
                chain[text] = [doc, mask, parts]
        for least, m, held in chain.values():
            yield from settle(least, m, held)

    return run


def failures(docs: DataFrame, rules=RULES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``(doc_id, text, lang)`` -> ``(doc_id, part, mask, rows)``: how many rows of a doc_id fail exactly the filters of a mask."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary"), F.coalesce("lang", F.lit("")), F.xxhash64(text)).rdd
    folded: RDD = rows.mapPartitions(_fold(rules, held_bytes))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(rows.getNumPartitions(), -(-size // ROUTED_BYTES), 1)
    routed = folded.repartitionAndSortWithinPartitions(parts, lambda key: key)  # ints; Python's % is never negative
    found = routed.mapPartitions(_chains(1 << len(rules)))
    return docs.sparkSession.createDataFrame(found, "doc_id long, part string, mask int, rows long", verifySchema=False)


def non_minimum_ids(docs: DataFrame) -> DataFrame:
    """The distinct doc_ids of documents whose text a smaller doc_id has."""
    return failures(docs, ()).where("mask = 1").select("doc_id").distinct()


def labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """With ``good`` and ``toxic``. Rows without doc_id match nothing; they get a random second key, so that they are no hot one."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    spread = failed.withColumn("_salt", F.when(F.col("doc_id").isNull(), F.floor(F.rand(13) * 1024)).otherwise(0))
    joined = spread.join(said.withColumn("_none", F.lit(0)), (F.col("doc_id") == F.col("_id")) & (F.col("_salt") == F.col("_none")), "left")
    return joined.select("part", "mask", "rows", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def mask_counts(rows: RDD, n_filters: int) -> RDD:
    """``(part, mask, rows, good, toxic)`` -> ``(part, counts)``: three counts a mask, one after the other: all, good, toxic."""
    size = 3 << n_filters

    def add(counts: list[int], row: tuple) -> list[int]:
        mask, n, good, toxic = row
        counts[3 * mask] += n
        counts[3 * mask + 1] += n * good
        counts[3 * mask + 2] += n * toxic
        return counts

    keyed = rows.map(lambda r: (r[0], tuple(r[1:])))
    return keyed.combineByKey(lambda row: add([0] * size, row), add, lambda a, b: [x + y for x, y in zip(a, b)])


def _orders(n_filters: int):
    """One part's counts to a row for each order of the filters and each step."""
    letters = [chr(ord("A") + i) for i in range(n_filters)]

    def run(item: tuple) -> Iterator[tuple]:
        part, counts = item
        total = sum(counts[::3])

        def lost(i: int, before: int) -> tuple[int, ...]:
            """Removed, good and toxic ones among them, by filter i after the filters of a mask."""
            hit = [m for m in range(1 << n_filters) if m >> i & 1 and not m & before]
            return tuple(sum(counts[3 * m + k] for m in hit) for k in range(3))

        removed = {(i, before): lost(i, before) for i in range(n_filters) for before in range(1 << n_filters) if not before >> i & 1}
        failing = [removed[i, 0][0] for i in range(n_filters)]
        orders = list(permutations(range(n_filters)))
        shapley = [0] * n_filters
        for order in orders:
            before = 0
            for i in order:
                shapley[i] += removed[i, before][0]
                before |= 1 << i
        for order in orders:
            before, kept = 0, total
            for step, i in enumerate(order, 1):
                gone, good, toxic = removed[i, before]
                kept -= gone
                yield part, "".join(letters[j] for j in order), step, kept, gone, failing[i] - gone, counts[3 << i], good, toxic, shapley[i]
                before |= 1 << i

    return run


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """A row per part, order of the filters and step."""
    n = len(rules) + 1
    counts = mask_counts(labelled(failures(docs, rules), labels).rdd, n)
    return docs.sparkSession.createDataFrame(counts.flatMap(_orders(n)), AUDIT, verifySchema=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}') AS w FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, a.bit AS b1, b.bit AS b2, c.bit AS b3, d.bit AS b4, e.bit AS b5
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, 1 AS step, b1 AS bit, 0 AS earlier FROM o UNION ALL SELECT filter_order, 2, b2, b1 FROM o UNION ALL SELECT filter_order, 3, b3, b1 + b2 FROM o
  UNION ALL SELECT filter_order, 4, b4, b1 + b2 + b3 FROM o UNION ALL SELECT filter_order, 5, b5, b1 + b2 + b3 + b4 FROM o),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN (mask & (bit + earlier)) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier) = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier) > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier) = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN (mask & bit) > 0 AND (mask & earlier) = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
