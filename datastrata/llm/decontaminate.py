"""Operator 2: benchmark decontamination.

One Aho-Corasick automaton holds the windows of all benchmark items: ``WINDOW``
consecutive normalised words, or all words of a shorter item. Its letters are words: every word of the benchmark is one
code point, every other word one that no window has, so a window of 13 words is 13 letters and a document is scanned a word a step.
A document is normalised and scanned once; a hit's place gives its words, and the words give the span in the original text.

The automaton is built in each worker from the broadcast items. Their words are
counted first: one automaton holds ``BLOCK_WORDS`` words at most (about 200 MB). The benchmark is a given, small table; one beyond that is
scanned block by block, each block's hits written before the next is broadcast, and the hits of a document united
by the hash of its text, with the same columns. Documents are only ever read and mapped, never shuffled, with one
block.

Defined cases: a null or empty text has no words and is clean; a null or empty item has no
window; a null item_id's windows hit, but are not counted as an item; items with equal ids count
once; equal documents are judged each; empty tables give empty or clean results;
other columns are ignored by the report and kept by the filter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.llm.common import small_batches, table, written

WINDOW = 13
BLOCK_WORDS = 400_000
#: Contaminated: at least one word in ``SHARE`` is hit.
SHARE = 20

#: ASCII letters to lower case, other ASCII but digits to a space, all else as it is.
_TO = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
NORMAL_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ORIGINAL = re.compile(NORMAL_WORD)

Item = tuple[str | None, str | None]


def normal_words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    return raw.translate(_TO).split()


def windows(item: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = normal_words(item)
    if not w:
        return []
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]


class Scanner:
    def __init__(self, items: list[Item], size: int = WINDOW):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        found: dict[str, tuple[int, set[str | None]]] = {}
        for name, text in items:
            for w in windows(text, size):
                found.setdefault("".join(map(self._letter, w)), (len(w), set()))[1].add(name)
        self.automaton = ahocorasick.Automaton()
        for key, value in found.items():
            self.automaton.add_word(key, value)
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def _letter(self, word: bytes) -> str:
        """The word's code point: from 1 on, without surrogates."""
        k = len(self.letters) + 1
        return self.letters.setdefault(word, chr(k if k < 0xD800 else k + 0x800))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items that hit."""
        hit = np.zeros(len(words) + 1, dtype=np.int64)
        items: set[str] = set()
        if words and not self.empty:
            for last, (n, names) in self.automaton.iter("".join(map(self.letters.get, words, repeat("\0")))):
                hit[last + 1 - n] += 1
                hit[last + 1] -= 1
                items |= names
        return np.cumsum(hit[:-1]) > 0, items - {None}


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def original_spans(text: str, word_runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code points of the text they came from."""
    places = [m.span() for m in _ORIGINAL.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in word_runs]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[Item]]:
    """Items in blocks of bounded size, read one after another."""
    some, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = len(normal_words(row[1]))
        if some and held + n > block_words:
            yield some
            some, held = [], 0
        some.append((row[0], row[1]))
        held += n
    yield some


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUNS = "array<struct<start: long, end: long>>"
_PLACES = pa.list_(pa.struct([(c, pa.int64()) for c in ("a", "b", "start", "end")]))
_PLACE = "a: bigint, b: bigint, start: bigint, end: bigint"


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode("utf-8")).hexdigest()


def _report(block: Broadcast, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(block.value, size)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = normal_words(text)
                hit, items = scanner.scan(words)
                found = runs(hit)
                n = int(hit.sum())
                spans = [{"start": a, "end": b} for a, b in original_spans(text, found)] if found else []
                rows.append((len(words), n, len(items), _digest(items), n > 0 and SHARE * n >= len(words), sorted(items), spans))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.list_(pa.string()), _SPANS])),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    return run


def _hits(block: Broadcast, size: int):
    """Documents with hits only: the hash of the text, runs of hit words with their places in the text, and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(block.value, size)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hit, items = scanner.scan(normal_words(text))
                if hit.any():
                    found = runs(hit)
                    places = zip(found, original_spans(text, found))
                    rows.append((key, [{"a": a, "b": b, "start": c, "end": d} for (a, b), (c, d) in places], sorted(items)))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.string(), _PLACES, pa.list_(pa.string())])], names=["key", "runs", "items"]
            )

    return run


def unite_hits(texts: DataFrame, blocks_: list[list[Item]], more: Iterator[list[Item]], size: int) -> DataFrame:
    """``(key, text)`` scanned with each block -> ``(key, n_hit, items, spans)`` of the texts with hits. A
    text's hits are at most as long as itself."""
    spark = texts.sparkSession
    found = None
    for block in chain(blocks_, more):
        shared = spark.sparkContext.broadcast(block)
        part = texts.mapInArrow(_hits(shared, size), f"key string, runs array<struct<{_PLACE}>>, items array<string>")
        part = written(part.groupBy("key").agg(F.first("runs").alias("runs"), F.first("items").alias("items")), "block-hits")
        shared.destroy()
        found = part if found is None else found.unionAll(part)
    united = found.groupBy("key").agg(
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def grown(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"), last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        joins = (F.size(acc) > 0) & (r["a"] <= last["b"])
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(r)))

    merged = united.withColumn("runs", F.aggregate("runs", F.array().cast(f"array<struct<{_PLACE}>>"), grown))
    return merged.select(
        "key",
        F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"]).alias("n_hit"),
        "items",
        F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"),
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document: counts, items and the spans in the text."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = blocks(benchmark, block_words)
    first, second = next(parts), next(parts, None)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if second is None:
        return d.mapInArrow(
            _report(spark.sparkContext.broadcast(first), size),
            "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
            f"items array<string>, spans {_RUNS}",
        )
    # Many blocks: a scan for each, then the hits of equal texts united.
    keyed = d.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    united = unite_hits(keyed.select("key", "text"), [first, second], parts, size)
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NORMAL_WORD)).cast("long")
    out = keyed.select("doc_id", "key", n_words.alias("n_words")).join(united, "key", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), items.alias("items"), F.coalesce("spans", F.array().cast(_RUNS)).alias("spans"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"),
        "items",
        "spans",
    )


def _keep(block: Broadcast, at: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(block.value, size)
        for batch in batches:
            clean = []
            for text in batch.column(at).to_pylist():
                words = normal_words(text)
                n = int(scanner.scan(words)[0].sum())
                clean.append(not (n > 0 and SHARE * n >= len(words)))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the contaminated ones, all columns as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = blocks(benchmark, block_words)
    first, second = next(parts), next(parts, None)
    if second is None:
        return docs.mapInArrow(_keep(spark.sparkContext.broadcast(first), docs.columns.index("text"), size), docs.schema)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), "text", packed)
    united = unite_hits(keyed.select("key", "text"), [first, second], parts, size)
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NORMAL_WORD))
    joined = keyed.join(united, "key", "left").where(~F.coalesce(F.col("n_hit") * SHARE >= n, F.lit(False)))
    return joined.select("doc.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP2_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM d, ns, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
h AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) AS u(j) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
