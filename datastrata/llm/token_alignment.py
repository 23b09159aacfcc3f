"""Operator 11: alignment of two tokenizers over a corpus.

Both tokenizers cut the same bytes, so their tokens are lined up by where they end: cumulative lengths give the ends, what both
have are the common cuts, and a token's group is the number of common cuts before its end. Tokens of a group are linked. All documents of a batch
are aligned at once, end to end, as their bytes are the same for both.

1. Each text is encoded once, and its ids are written, two bytes each where the vocabularies allow it, with what is known from the document alone.
2. A task makes the distinct linked pairs of each document from the ids, by repeats of each group's sides, and adds them up over
   many documents; a salted and then a plain shuffle add up the rest. A pair's count is how many documents hold it.
3. Each document's pairs meet their counts: at most ``COMMON_PAIRS`` most frequent ones are broadcast, which most links need;
   the rare rest is joined by shuffle. No frequent pair is in that join, so it has no hot key.

A group of m and n tokens has m * n links, counted as a product: within a group, equal ids are one row with their number.

Defined cases: a document whose text is null or empty, or whose tokens do not give its text back on either side, has no tokens: zeros and ''.
Repeated rows and equal doc_ids are documents each; null doc_ids are kept; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datastrata.llm.common import free, small_batches, table, written
from datastrata.llm.token_counts import byte_alphabet
from datastrata.llm.token_output import PieceEncoder, join_pieces, split_pieces, tokenizer_path

#: Pairs that a task adds up at once, salts of the first shuffle, and pairs that are broadcast with their counts (17 bytes each).
HELD_PAIRS, SALTS, COMMON_PAIRS = 2_000_000, 16, 1 << 20
#: Tokens of both sides that are aligned at once (one document at least), and pieces of text whose ids a worker keeps.
AT_ONCE, PIECES = 1 << 18, 600_000


class SpacedEncoder(PieceEncoder):
    """Ids of texts with a space before them; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path, PIECES)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        value = {c: b for b, c in byte_alphabet().items()}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(value[c] for c in piece) if all(c in value for c in piece) else piece.encode()

    def ids(self, texts: list[str], found: list[str], places: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        cells = self.known(found)
        return _joined(cells, texts, places, begins, lambda some: self._library([" " + t for t in some]))


def _joined(cells: list[bytes | None], texts: list[str], places: np.ndarray, begins: np.ndarray, library) -> list[np.ndarray]:
    """Ids of texts from those of their pieces; of texts with a piece that is not encoded alone, by the library."""
    out = join_pieces([c or b"" for c in cells], places, begins)
    alone = np.array([c is None for c in cells])
    if alone.any():
        whole = np.flatnonzero(np.logical_or.reduceat(alone[places], begins[:-1])).tolist()
        for i, found in zip(whole, library([texts[i] for i in whole])):
            out[i] = np.frombuffer(found, "<u4")
    return out


class Pieces:
    """A sentencepiece model; it puts the space before the text itself. No piece of its vocabulary goes on after a space, so a text
    with single spaces has the ids of the words between them, and those of known words are kept."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

        if any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(len(pieces))):
            raise ValueError("a piece goes on after a space")
        self.known: dict[str, bytes | None] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(i, "<u4").tobytes() for i in self.model.encode(texts, num_threads=1)]

    def ids(self, texts: list[str], found: list[str], places: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        fresh = [w for w in found if w not in self.known]
        if len(self.known) + len(fresh) > PIECES:
            self.known.clear()
            fresh = found
        self.known.update(zip(fresh, self._library(fresh)))
        self.known.update((w, None) for w in fresh if not w or "▁" in w)
        return _joined(list(map(self.known.__getitem__, found)), texts, places, begins, self._library)


class Sides:
    """Both tokenizers of a worker, the lengths of their tokens, and ids as text with what may follow them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = SpacedEncoder(a_path), Pieces(b_path)
        self.a_len, self.b_len = (np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b))
        size = max(len(self.a_len), len(self.b_len))
        self.type = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.shown = [b"%d%s" % (i, mark) for i in range(size) for mark in (b",", b"|", b";")]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none where the text does not come back from them."""
        none = np.zeros(0, "<u4")
        out = []
        if not texts:
            return out
        split = split_pieces(texts)
        for text, a, b in zip(texts, self.a.ids(texts, *split), self.b.ids(texts, *split)):
            raw = b" " + text.encode()
            same = text and raw == b"".join(map(self.a.bytes.__getitem__, a.tolist())) == b"".join(map(self.b.bytes.__getitem__, b.tolist()))
            out.append((a, b) if same else (none, none))
        return out


@lru_cache(maxsize=1)
def worker_sides(a_path: str, b_path: str) -> Sides:
    """One pair of tokenizers for all tasks of a Python worker."""
    return Sides(a_path, b_path)


class Aligned:
    """The groups of many documents, whose ids follow each other."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray):
        a_ends, b_ends = np.cumsum(a_len[a]), np.cumsum(b_len[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        self.n_a, self.n_b = np.bincount(self.a_group, minlength=len(common)), np.bincount(self.b_group, minlength=len(common))
        self.a, self.b = a, b

    def listing(self) -> np.ndarray:
        """For each token, A's and B's of a group after each other, three times its id plus the mark that follows it."""
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        at_a = np.arange(len(self.a)) + (np.cumsum(self.n_b) - self.n_b)[self.a_group]
        at_b = np.arange(len(self.b)) + np.cumsum(self.n_a)[self.b_group]
        last_a, last_b = np.cumsum(self.n_a) - 1, np.cumsum(self.n_b) - 1
        codes[at_a], codes[at_b] = 3 * self.a.astype(np.int64), 3 * self.b.astype(np.int64)
        codes[at_a[last_a]] += 1
        codes[at_b[last_b]] += 2
        return codes

    def pairs(self, doc_of_group: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(doc, key, links)`` of each document's distinct pairs, in order; the key is ``a * n_b + b``."""

        def sides(group: np.ndarray, ids: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Ids and their numbers by group, an id once in each, and how many a group has."""
            keys, times = np.unique((group.astype(np.int64) << 32) | ids, return_counts=True)
            return keys & 0xFFFFFFFF, times, np.bincount(keys >> 32, minlength=n_groups)

        # Most groups are one token of each side, and one pair as they are.
        one = (self.n_a == 1) & (self.n_b == 1)
        one_a, one_b = one[self.a_group], one[self.b_group]
        single = self.a[one_a].astype(np.int64) * n_b + self.b[one_b]
        n = len(self.n_a)
        a, a_times, in_a = sides(self.a_group[~one_a], self.a[~one_a], n)
        b, b_times, in_b = sides(self.b_group[~one_b], self.b[~one_b], n)
        group = np.repeat(np.arange(n), in_a)
        wide = in_b[group]  # each of A's meets so many of B's
        left = np.repeat(np.arange(len(a)), wide)
        right = np.arange(len(left)) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat((np.cumsum(in_b) - in_b)[group], wide)
        key = np.concatenate([single, a[left] * n_b + b[right]])
        doc = doc_of_group[np.concatenate([np.flatnonzero(one), group[left]])].astype(np.int64)
        links = np.concatenate([np.ones(len(single), np.int64), a_times[left] * b_times[right]])
        bits = int(key.max(initial=0)).bit_length()
        if bits + int(doc.max(initial=0)).bit_length() < 64:
            order = np.argsort((doc << bits) | key)
        else:
            order = np.lexsort((key, doc))
        doc, key, links = doc[order], key[order], links[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)])
        return doc[first], key[first], np.add.reduceat(links, first) if len(first) else links


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    """Documents one after another, of AT_ONCE tokens or one document."""
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > AT_ONCE:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


ENCODED = "row long, doc_id long, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _encode(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, row = worker_sides(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            docs, everything = batch.column(0), sides.encode([t or "" for t in batch.column(1).to_pylist()])
            for some in _runs(np.array([len(a) + len(b) for a, b in everything])):
                found = everything[some]
                n_a, n_b = (np.array([len(pair[k]) for pair in found], np.int64) for k in (0, 1))
                whole = Aligned(*(np.concatenate([pair[k] for pair in found]) for k in (0, 1)), sides.a_len, sides.b_len)
                codes, ends = whole.listing().tolist(), np.cumsum(n_a + n_b).tolist()
                first = np.concatenate([[0], np.cumsum(n_a)])
                label = np.append(whole.a_group, len(whole.n_a))[first]  # a document's first group
                links = np.concatenate([[0], np.cumsum(whole.n_a * whole.n_b)])[label]
                shas = []
                for k, end in enumerate(ends):
                    text = b"".join(map(sides.shown.__getitem__, codes[end - n_a[k] - n_b[k] : end]))
                    shas.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(found))),
                        docs.slice(some.start, len(found)),
                        *(pa.array([pair[k].astype(sides.type).tobytes() for pair in found], pa.binary()) for k in (0, 1)),
                        *(pa.array(v, pa.int64()) for v in (n_a, n_b, np.diff(label), np.diff(links))),
                        pa.array(shas, pa.string()),
                    ],
                    names=["row", "doc_id", "a", "b", *NUMBERS, "groups_sha256"],
                )
                row += len(found)

    return run


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(a_path, b_path), ENCODED)


def _pairs_of(sides: Sides, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """``pairs`` of runs of a batch of encoded rows; documents are places in the run."""
    a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
    groups = batch.column("n_groups").to_numpy()
    for some in _runs(np.array([len(x) + len(y) for x, y in zip(a, b)]) // sides.type.itemsize):
        whole = Aligned(*(np.frombuffer(b"".join(side[some]), sides.type) for side in (a, b)), sides.a_len, sides.b_len)
        yield some, *whole.pairs(np.repeat(np.arange(some.stop - some.start), groups[some]), len(sides.b_len))


def _count(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, held, size = worker_sides(a_path, b_path), [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for _, _, keys, _ in _pairs_of(sides, batch):
                held.append(keys)
                size += len(keys)
                if size >= HELD_PAIRS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def pair_counts(rows: DataFrame, a_path: str, b_path: str, n_b: int) -> DataFrame:
    """``encoded`` rows to ``(pair, n, best)``: documents that hold a pair linked, and whether its A id has no pair with more."""
    some = rows.select("a", "b", "n_groups").mapInArrow(_count(a_path, b_path), "pair long, n long")
    salted = some.groupBy("pair", (F.spark_partition_id() % SALTS).alias("_salt")).agg(F.sum("n").alias("n"))
    added = salted.groupBy("pair").agg(F.sum("n").alias("n"))
    # An A id has no more pairs than B has ids.
    most = F.max("n").over(W.partitionBy(F.floor(F.col("pair") / n_b)))
    return added.select("pair", "n", (F.col("n") == most).alias("best"))


def _common(pairs: DataFrame, limit: int) -> int:
    """The least count so that at most ``limit`` pairs have it or more, from a histogram over powers of two's quarters."""
    step = F.floor(F.log2("n") * 4)
    rows = pairs.groupBy(step.alias("step")).agg(F.count("*").alias("c"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    held, least = 0, 1 << 62
    for r in rows:
        held += r.c
        if held > limit:
            break
        least = r.n
    return least


def _meet(a_path: str, b_path: str, common):
    """Encoded rows to ``(row, key, times, n_best, count_sum)``: a row with the sums over common pairs, under a key that is no pair, and one
    for each pair that is not common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = worker_sides(a_path, b_path)
        keys, counts, best = common.value
        for batch in batches:
            for some, doc, key, links in _pairs_of(sides, batch):
                row = batch.column("row").to_numpy()[some]
                at = np.searchsorted(keys, key)
                known = np.append(keys, -1)[at] == key
                d, at, times = doc[known], at[known], links[known]
                total, hits = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
                np.add.at(total, d, times * counts[at])
                np.add.at(hits, d, times * best[at])
                rest = ~known
                none, zero = np.zeros(len(row), np.int64), np.zeros(int(rest.sum()), np.int64)
                columns = ([row, row[doc[rest]]], [-1 - row, key[rest]], [none, links[rest]], [hits, zero], [total, zero])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["row", "pair", "times", "hits", "total"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """A row per document: tokens, groups and links, and how its pairs count over all documents."""
    spark = docs.sparkSession
    n_b = len(Pieces(b_path).bytes)
    rows = written(encoded(docs, a_path, b_path), "encoded")
    pairs = written(pair_counts(rows, a_path, b_path, n_b), "pair-counts")
    least = _common(pairs, common_pairs)
    top = pairs.where(F.col("n") >= least).orderBy("pair").toPandas()  # at most common_pairs rows
    common = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)))
    met = rows.select("row", "a", "b", "n_groups").mapInArrow(_meet(a_path, b_path, common), "row long, pair long, times long, hits long, total long")
    joined = met.join(pairs.where(F.col("n") < least), "pair", "left")
    mine = F.coalesce(F.col("times") * F.col("n"), F.lit(0)), F.when(F.col("best"), F.col("times")).otherwise(0)
    sums = joined.groupBy("row").agg(F.sum(F.col("total") + mine[0]).alias("count_sum"), F.sum(F.col("hits") + mine[1]).alias("n_best"))
    found = rows.select("row", "doc_id", *NUMBERS, "groups_sha256").join(sums, "row")
    out = written(found.select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"), "aligned")
    free(rows, pairs)
    return out


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
