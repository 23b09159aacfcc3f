"""Operator 12: document fingerprints by a randomised edit embedding.

A text is cut where its content says so: at characters whose hash, over the last few, is the least around. Along each segment walks a pointer:
at every step the character under it is written down, and a random bit, which all walks share for this step and this character,
says whether the pointer moves on. Walks over texts of small edit distance fall into step again soon after an edit, so they write
sequences of small Hamming distance. All segments of many texts walk at once, a step at a time.

A band is a fixed sample of steps, the written characters at which are hashed to one number; each slot of the fingerprint keeps, as one byte, the
least of one band's numbers over all segments under the slot's own permutation. The share of equal slots of two fingerprints estimates the
resemblance of the texts' segments r, and their likeness is 2r / (1 + r): about the share of text that they have in common.

``near_copies`` compares fingerprints by bands of slots: those that share one meet, and are verified by their likeness.

``edited`` needs the next document of each: rows go to partitions by ranges of the descending order, whose borders come from a bounded
sample, and the first row of each range goes to the one before as well.

Defined cases: a null text is an empty one; an empty text's fingerprint is all zeros; null doc_ids come last in the descending order; rows of
equal doc_id follow in the order of their text's hash and text; one document alone is its own next; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.llm.common import free, small_batches, table, written
from datastrata.llm.components import components

#: Cuts are more than AROUND characters apart, a power of two, and segments at most LONGEST long; a walk has three steps a character.
WINDOW, AROUND, LONGEST = 4, 16, 64
STEPS = 3 * LONGEST
#: Steps that each band samples, besides the first. Bands of few steps are for texts of few segments.
BANDS = (4, 8) + 14 * (16,)
SLOTS = 128
#: Slots of a band of the fingerprint for ``near_copies``, and the least likeness of near copies.
BAND_SLOTS, LIKE = 4, 0.75
#: Characters that walk at once, and the bound of the sample of keys for the borders (as Spark's own ranges have): it affects the balance alone.
WALK_CHARS, SAMPLE, MOST_SAMPLED = 1 << 19, 100, 1_000_000
GAP = WINDOW + AROUND


class Walks:
    """The shared random choices, from a fixed seed."""

    def __init__(self, seed: int = 12):
        rnd = np.random.default_rng(seed)
        self.moves = rnd.integers(0, 2, (STEPS, 256), np.uint8)
        self.window = rnd.integers(1, 1 << 63, WINDOW, np.uint64) | np.uint64(1)
        half = STEPS // 3
        near = np.r_[np.full(half, 2.0), np.full(STEPS - half, 1.0)]  # a segment of usual length is written in the first third
        samples = [{0, *rnd.choice(STEPS, k, False, near / near.sum()).tolist()} for k in BANDS]
        self.samples = [[(b, np.uint64(rnd.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1))) for b, s in enumerate(samples) if j in s] for j in range(STEPS)]
        self.slots = rnd.integers(1, 1 << 63, SLOTS, np.uint64) | np.uint64(1)

    def segments(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the segments of texts that have GAP zeros between them."""
        wide = letters.astype(np.uint64)
        h = wide * self.window[0]
        for k in range(1, WINDOW):
            h[k:] += wide[:-k] * self.window[k]
        h = mixed(h)
        inside = np.zeros(len(letters) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        h[np.cumsum(inside[:-1]) == 0] = np.iinfo(np.uint64).max
        run, size = h, 1  # least of the places i to i + size - 1
        while size < AROUND:
            run = np.minimum(run, np.r_[run[size:], np.full(size, np.iinfo(np.uint64).max, np.uint64)])
            size *= 2
        top = np.full(AROUND, np.iinfo(np.uint64).max, np.uint64)
        before, after = np.r_[top, run[:-AROUND]], np.r_[run[1:], top[:1]]
        cuts = np.flatnonzero((h < before) & (h <= after)) + 1
        some = ends > starts
        begins = np.union1d(starts[some], np.setdiff1d(cuts, ends))
        lengths = np.minimum(np.r_[begins[1:], len(letters)], ends[some][np.searchsorted(starts[some], begins, "right") - 1]) - begins
        pieces = -(-lengths // LONGEST)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins, lengths, pieces = (np.repeat(x, pieces) for x in (begins, lengths, pieces))
        return begins + k * lengths // pieces, (k + 1) * lengths // pieces - k * lengths // pieces

    def numbers(self, letters: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A number for each band and segment."""
        out = np.zeros((len(BANDS), len(begins)), np.uint64)
        kind = ((letters * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
        lanes, at, end = np.arange(len(begins)), begins.copy(), begins + lengths
        for j in range(STEPS):
            if j % 8 == 0 and j:
                going = at < end
                lanes, at, end = lanes[going], at[going], end[going]
            on = at < end  # others have written all they have: zeros
            place = np.where(on, at, 0)
            if self.samples[j]:
                seen = np.where(on, letters[place], np.uint32(0)).astype(np.uint64)
                for band, factor in self.samples[j]:
                    out[band, lanes] += seen * factor
            at = at + (self.moves[j][kind[place]] & on)
        return out

    def fingerprints(self, texts: list[np.ndarray]) -> np.ndarray:
        """Code points of texts to a row of bytes each."""
        sizes = np.array([len(t) for t in texts], np.int64)
        gap = np.zeros(GAP, np.uint32)
        letters = np.concatenate([x for t in texts for x in (gap, t)] + [gap])
        ends = np.cumsum(sizes + GAP)
        starts = ends - sizes
        out = np.zeros((len(texts), SLOTS), np.uint8)
        begins, lengths = self.segments(letters, starts, ends)
        if not len(begins):
            return out
        numbers = mixed(self.numbers(letters, begins, lengths))
        first = np.searchsorted(begins, starts[sizes > 0])
        for slot, factor in enumerate(self.slots):
            least = np.minimum.reduceat(numbers[slot % len(BANDS)] * factor, first)
            out[sizes > 0, slot] = mixed(least) & np.uint64(255)
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = (a == b).mean(axis=1)
    return 2 * same / (1 + same)


def _chunks(texts: list[str]) -> Iterator[list[int]]:
    held, size = [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > WALK_CHARS:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(t) + GAP
    if held:
        yield held


def _shown(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


# -- the next document ------------------------------------------------------


def _key() -> list[Column]:
    """The descending order as ascending numbers: the last place is that of null doc_ids."""
    return [F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit((1 << 63) - 1)).alias("_o"), F.xxhash64("text").alias("_h")]


class Ranges:
    """Borders of ranges of ``(order, hash)``, and where the first row of each goes besides."""

    def __init__(self, borders: list[tuple[int, int]]):
        self.o, self.h = (np.array([b[k] for b in borders], np.int64) for k in (0, 1))
        self.firsts: dict[int, tuple[int, int]] = {}

    def of(self, o: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How many borders are not after each key."""
        low, high = np.searchsorted(self.o, o), np.searchsorted(self.o, o, "right")
        for value in np.unique(o[high > low]):
            mine = np.flatnonzero(o == value)
            a, b = low[mine[0]], high[mine[0]]
            low[mine] = a + np.searchsorted(self.h[a:b], h[mine], "right")
        return low

    def also(self, found: np.ndarray, o: np.ndarray, h: np.ndarray) -> list[list[int]]:
        """The places of each row: its own range and, of a range's first row, the range before, as a negative number."""
        firsts, ranges = self.firsts, sorted(self.firsts)
        before = dict(zip(ranges, ranges[-1:] + ranges[:-1]))
        return [[r, -1 - before[r]] if firsts.get(r) == (a, b) else [r] for r, a, b in zip(found.tolist(), o.tolist(), h.tolist())]


def _ranges(keys: DataFrame, parts: int) -> Ranges:
    n = keys.count()
    some = keys if n <= SAMPLE * parts else keys.sample(min(SAMPLE * parts, MOST_SAMPLED) / n, 12)
    found = sorted(map(tuple, some.collect())) if n else []
    ranges = Ranges(sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else [])

    @F.pandas_udf("int")
    def range_of(o: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(o.to_numpy(), h.to_numpy()))

    # A row for each range, of which there are as many as partitions.
    first = keys.groupBy(range_of("_o", "_h").alias("r")).agg(F.min(F.struct("_o", "_h")).alias("k")).collect()
    ranges.firsts = {row.r: tuple(row.k) for row in first}
    return ranges


def in_order(docs: DataFrame) -> DataFrame:
    """Rows in descending order of doc_id within each partition, the row after the last one of a partition as its last, with ``_range`` < 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *_key())
    parts = max(docs.rdd.getNumPartitions(), 1)
    ranges = _ranges(rows.select("_o", "_h"), parts)

    @F.pandas_udf("array<int>")
    def places(o: pd.Series, h: pd.Series) -> pd.Series:
        o, h = o.to_numpy(), h.to_numpy()
        return pd.Series(ranges.also(ranges.of(o, h), o, h))

    placed = rows.withColumn("_range", F.explode(places("_o", "_h")))
    own = F.when(F.col("_range") < 0, -1 - F.col("_range")).otherwise(F.col("_range"))
    sent = placed.withColumn("_at", own).repartitionById(parts, F.col("_at"))
    return sent.sortWithinPartitions("_at", F.col("_range") < 0, F.col("doc_id").desc_nulls_last(), "_h", "text").select("doc_id", "text", "_range")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walks, kept = Walks(), []
    for batch in batches:
        rows = kept + list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_range"))))
        kept = rows[-1:]
        for some in _chunks([text for _, text, _ in rows[:-1]]):
            some = [i for i in some if rows[i][2] >= 0]
            if not some:
                continue
            edited = [rows[i][1][: len(rows[i][1]) - len(rows[i][1]) // 2] + rows[i + 1][1][: len(rows[i][1]) // 2] for i in some]
            needed = sorted({*some, *(i + 1 for i in some)})
            found = walks.fingerprints([*(points(rows[i][1]) for i in needed), *map(points, edited)])
            at = {i: k for k, i in enumerate(needed)}
            own, after, changed = found[[at[i] for i in some]], found[[at[i + 1] for i in some]], found[len(needed) :]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][0] for i in some], pa.int64()),
                    pa.array([len(rows[i][1]) for i in some], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(_shown(own)),
                    pa.array(_shown(changed)),
                    pa.array(likeness(own, changed)),
                    pa.array(likeness(own, after)),
                ],
                names=[c.split()[0] for c in EDITED.split(", ")],
            )


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text whose second half is the beginning of the next document's."""
    small_batches(docs.sparkSession)
    return in_order(docs).mapInArrow(_edited, EDITED)


# -- near copies ------------------------------------------------------------


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walks = Walks()
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        shown = [s for some in _chunks(texts) for s in _shown(walks.fingerprints([points(texts[i]) for i in some]))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shown, pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fingerprint string")


def _like(a: pd.Series, b: pd.Series) -> pd.Series:
    side = lambda s: np.frombuffer(bytes.fromhex("".join(s)), np.uint8).reshape(len(s), -1)
    return pd.Series(likeness(side(a), side(b)) if len(a) else [], dtype=float)


def near_copies(docs: DataFrame, least: float = LIKE) -> DataFrame:
    """``(doc_id, class_id)``: texts whose fingerprints share a band and are alike, or linked by such, are one class, named by its smallest doc_id.

    In each bucket of a band all meet the smallest; those not alike to it meet among themselves in the next round, until none is left."""
    prints = written(fingerprints(docs).where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.collect_set("doc_id").alias("ids"), F.min("doc_id").alias("id")), "prints")
    like, width = F.pandas_udf(_like, "double"), 2 * BAND_SLOTS
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2 * SLOTS // width - 1)), lambda k: F.substr("fingerprint", k * width + 1, F.lit(width))))
    left, links, made = prints.select("id", "fingerprint", band.alias("band", "value")), None, []
    while True:
        firsts = left.groupBy("band", "value").agg(F.min(F.struct("id", "fingerprint")).alias("first"), F.count("*").alias("n")).where("n > 1")
        met = left.join(firsts, ["band", "value"]).where("id <> first.id").withColumn("alike", like("fingerprint", "first.fingerprint") >= least)
        met = written(met, "met", n=F.count("*"))
        made.append(met)
        found = met.where("alike").select(F.col("id").alias("a"), F.col("first.id").alias("b")).distinct()
        links = found if links is None else links.unionAll(found)
        if not met.measured["n"]:
            break
        left = met.where("NOT alike").select("id", "fingerprint", "band", "value")
    out = prints.join(components(links.distinct()), "id", "left").select(F.explode("ids").alias("doc_id"), F.coalesce("root", "id").alias("class_id"))
    out = written(out, "near-copies")
    free(prints, *made)
    return out


def op12_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
