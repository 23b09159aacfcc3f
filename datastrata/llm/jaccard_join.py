"""Operator 3: exact n-gram Jaccard join by set relations.

Finds the connected components of "shingle sets of similarity ``T`` or more", without
listing the pairs within a group. Steps, each over all documents:

1. Digest. A text's set is the sorted 64-bit hashes of its word 5-grams. Documents of equal
   set are one class; only one text of a class goes on.
2. Sieve. Of sets that are similar, the first ``p`` shingles in any one order share one, and the first
   ``p + l - 1`` share ``l``. In order of hash, each set sends that sample; shingles that two sets have are credited to
   them, and only sets with ``l`` credits or more go on, ``l`` being that of the smallest set they could be similar to. Most
   texts end here. What repeats within a task is credited there and sent once, so a passage in a third of
   all texts is one row a task.
3. Order. All shingles of the sets that are left are counted, and ordered by count, then hash: those of one set
   first, common passages last. Any order is right, this one leaves the fewest pairs. Shingles that
   tasks have seen ``HOT_COUNT`` times or more, at most ``HOT_TOKENS`` of them, are broadcast with that count and not
   counted anew, so no task counts a passage in a third of all texts.
4. Lists. Prefix shingles are partitioned and sorted by (shingle, size, position), lists longer than
   ``LONG_LIST`` in parts; lists of one set are dropped. While a list streams by, each set is paired with the
   leading set of fitting size: as many pairs as entries. These are intersected exactly. Components of the links
   are found; then, in rounds, each list is ordered anew and each entry paired with the nearest one before it of another component, until
   no link is found or ``LINK_ROUNDS`` are over.
5. Across components. Each set is in the group of a similar leader. Lists of two components or more are reduced to groups, and pairs of groups
   are found by block-skipping: the entries of one size are ordered by position, and the rest of a block
   is skipped at the first that cannot reach the overlap. The leaders of a pair are intersected. What is known of them
   bounds their groups: for x with leader L, ``|x & z| <= |L & z| + |x - L|``. Where that excludes nothing, the answers
   of the members are derived from those of the leaders by the shingles in which they differ,
   ``|x & z| = |L & z| - |(L - x) & z| + |(x - L) & z|``, in pieces of ``PIECE`` members, and a row comes out only for a link.

Nothing is lost: sets that are similar share ``l`` shingles of their samples, then one of their prefixes, so a similar pair is in
one component after step 4, or in a pair of groups of step 5.

Defined cases: a null or wordless text has an empty set and is linked with nothing; fewer
words than five make one shingle; equal rows share a class; rows of equal doc_id and
different text are linked through their texts only; a null doc_id is never the smallest, and
gets null where its component has no other; an empty table gives no row; other
columns are ignored by the report and kept by the filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datastrata.llm.common import free, small_batches, table, written
from datastrata.llm.components import components, extended

SHINGLE = 5
#: Similarity: at least ``PERCENT`` hundredths.
PERCENT = 75
#: A set's sample has ``1 / SAMPLE`` more shingles than its prefix.
SAMPLE = 3
#: Bound of a task's counts and of the broadcast order: 4 MB.
HOT_TOKENS = 250_000
HOT_COUNT = 1000
LONG_LIST = 5_000
LINK_ROUNDS = 5
#: Partners that a set proposes in a round.
PARTNERS = 6
#: Members of a group that one row carries.
PIECE = 32
#: Ids to broadcast at most (24 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000
_FLUSH = 4_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, as int64."""
    import xxhash

    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    w = raw.translate(_LOWER).split()
    if not w:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    k = min(size, len(w))
    out = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = _mix(out * _P + h[i : len(w) - k + 1 + i])
    return np.unique(out.view(np.int64))


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int) -> int:
    """Shingles of which a set shares one, at least, with any similar set."""
    return n - -(-n * PERCENT // 100) + 1


def extra_length(n):
    """By how much a set's sample is longer than its prefix: samples of similar sets share one more than the less of theirs."""
    return (prefix_length(n) - 1) // SAMPLE


def least_overlap(n: np.ndarray | int, m: np.ndarray | int):
    """Intersection that sets of these sizes need."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class Frequent:
    """Counts of repeated shingles within a bound: below it exact for what repeats in a batch."""

    def __init__(self, limit: int):
        self.limit = limit
        self.tokens, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, sets: list[np.ndarray]) -> None:
        if not sets:
            return
        t, c = np.unique(np.concatenate(sets), return_counts=True)
        t, c = t[c > 1], c[c > 1]
        self.tokens, at = np.unique(np.concatenate([self.tokens, t]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, c]), len(self.tokens)).astype(np.int64)
        if len(self.tokens) > self.limit:
            cut = np.partition(self.counts, -self.limit)[-self.limit]
            keep = self.counts > cut
            self.tokens, self.counts = self.tokens[keep], self.counts[keep] - cut


def _pack(names: str, *parts: tuple) -> Iterator[pa.RecordBatch]:
    """Rows from columns; a scalar stands for all rows of its part, None for null."""
    for part in parts:
        m = next(len(x) for x in part if isinstance(x, (np.ndarray, list, pa.Array)))
        if m:
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.nulls(m, pa.int64()) if x is None else pa.array(np.full(m, x) if np.isscalar(x) else x, pa.int64()) for x in part],
                names=names.split(),
            )


#: Kinds of rows of the sieve: a document, credits of a set, a shingle credited in its task, one that is not, a count.
DOCUMENT, CREDITS, CREDITED, ENTRY, COUNT = range(5)
_SIEVE = "key sid kind doc_id n"


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, text_id) -> rows of the sieve, the shingles' by key and the others' anywhere."""
    frequent = Frequent(HOT_TOKENS)
    held: dict[int, np.ndarray] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        ids = np.fromiter(held, np.int64, len(held))
        sample = [s[: prefix_length(len(s)) + extra_length(len(s))] for s in held.values()]
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in sample])
        tokens, at, count = np.unique(np.concatenate(sample), return_inverse=True, return_counts=True)
        again = count[at] > 1
        credits = np.bincount(owner[again], minlength=len(ids))
        some = credits > 0
        yield from _pack(
            _SIEVE,
            (ids[some], ids[some], CREDITS, None, credits[some]),
            (tokens[count > 1], 0, CREDITED, None, 0),
            (tokens[at[~again]], ids[owner[~again]], ENTRY, None, 0),
        )
        frequent.add(list(held.values()))

    for batch in batches:
        sets = [shingles(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        ids = [set_id(s) for s in sets]
        if sets:
            yield from _pack(_SIEVE, (batch.column(2), ids, DOCUMENT, batch.column(0), [len(s) for s in sets]))
        for i, s in zip(ids, sets):
            if len(s) and i not in held:
                held[i] = s
                size += len(s)
        if size > _FLUSH:
            yield from flush()
            held, size = {}, 0
    yield from flush()
    keep = frequent.counts >= 8
    yield from _pack(_SIEVE, (frequent.tokens[keep], 0, COUNT, None, frequent.counts[keep]))


def _credited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the sieve in order of (key, kind, sid) -> documents, counts, and credits by set. Of the last shingle only
    one row waits for the next batch: an entry not yet credited, or that the shingle is."""
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    held: tuple[int, int, bool] | None = None
    for batch in batches:
        kind = batch.column(2).to_numpy()
        through = np.flatnonzero(np.isin(kind, (DOCUMENT, CREDITS, COUNT)))
        if len(through):
            yield batch.take(pa.array(through))
        own = (kind == CREDITED) | (kind == ENTRY)
        key, sid, mark = batch.column(0).to_numpy()[own], batch.column(1).to_numpy()[own], kind[own] == CREDITED
        if held is not None:
            key, sid, mark = np.r_[held[0], key], np.r_[held[1], sid], np.r_[held[2], mark]
        if not len(key):
            continue
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        several = np.logical_or.reduceat(mark, first)
        several |= np.minimum.reduceat(np.where(mark, most, sid), first) < np.maximum.reduceat(np.where(mark, least, sid), first)
        repeated = np.r_[False, (key[1:] == key[:-1]) & (sid[1:] == sid[:-1]) & ~mark[:-1]]
        ids, n = np.unique(sid[several[run] & ~mark & ~repeated], return_counts=True)
        yield from _pack(_SIEVE, (ids, ids, CREDITS, None, n))
        held = (int(key[-1]), int(sid[-1]), bool(several[-1]))


def _tokens(order: Broadcast):
    """Rows (key, token, sid, n, df) of all shingles of texts: df and the set as key for frequent ones, else 0 and the shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = order.value
        for batch in batches:
            sets = [s for t in batch.column(0).cast(pa.binary()).to_pylist() if len(s := shingles(t))]
            if not sets:
                continue
            n = [len(s) for s in sets]
            token, sid = np.concatenate(sets), np.repeat(np.array([set_id(s) for s in sets]), n)
            df, key = np.zeros(len(token), np.int64), token
            if len(hot):
                at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                known = hot[at] == token
                df[known] = count[at[known]]
                key = np.where(known, sid, token)
            yield from _pack("key token sid n df", (key, token, sid, np.repeat(n, n), df))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, token, sid) -> those of shingles of two sets or more, with the number of sets."""
    held: list[np.ndarray] | None = None

    def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, sid, n = cols
        if not len(token):
            return
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        df = np.diff(np.r_[first, len(token)])
        df = np.repeat(df, df)
        yield from _pack("sid token n df", (sid[df > 1], token[df > 1], n[df > 1], df[df > 1]))

    for batch in batches:
        key, token, sid, n, df = (batch.column(k).to_numpy() for k in range(5))
        known = df > 0
        yield from _pack("sid token n df", (sid[known], token[known], n[known], df[known]))
        cols = [x[~known] for x in (token, sid, n)]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(np.cumsum(cols[0][::-1] != cols[0][-1]), 1))  # rows of the last shingle: it may go on
        cut = len(cols[0]) - cut
        held = [x[cut:] for x in cols]
        yield from out([x[:cut] for x in cols])
    if held is not None:
        yield from out(held)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (list, sid, n, pos, token, part) in order of (list, n, pos, sid) -> those of lists of two sets or more and of
    parts of lists, each with its
    leader if the two can reach the overlap from here on, else with itself. A list of two
    that cannot is dropped. The last entry waits for what follows it, with its leader and
    the number of entries of its list before it; nothing else is kept between batches."""
    last: list[np.ndarray] | None = None
    lead: list[int] = []
    before = 0

    def out(cols: list[np.ndarray], leader: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c[keep], t) for c, t in zip([cols[4], *cols[1:4], leader], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))],
            names=["token", "sid", "n", "pos", "lead"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)]
        if last is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(last, cols)]
        token, sid, n, pos, _, part = cols
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.concatenate([first, [len(token)]]))
        run = np.repeat(np.arange(len(first)), length)
        leads = [sid[first][run], n[first][run], pos[first][run]]
        for x, y in zip(leads, lead):  # the first list goes on under its leader
            x[run == 0] = y
        length[0] += before
        for k in np.unique(run[100 * leads[1] < PERCENT * n]):  # outgrown leaders: later ones take over
            a, b = first[k], first[k + 1] if k + 1 < len(first) else len(token)
            now = [x[a] for x in leads]
            for i in range(a, b):
                if 100 * now[1] < PERCENT * n[i]:
                    now = [sid[i], n[i], pos[i]]
                for x, y in zip(leads, now):
                    x[i] = y
        can = np.minimum(n - pos, leads[1] - leads[2]) >= least_overlap(n, leads[1])
        keep = (length[run] > 1) | (part > 0)
        two = first[:-1][(length[:-1] == 2) & (part[first[:-1]] == 0)]
        if before:
            two = two[two > 0]
        lost = two[~can[two + 1]]
        keep[lost] = keep[lost + 1] = False
        keep[-1] = False
        yield out(cols, np.where(can, leads[0], sid), keep)
        last, lead, before = [c[-1:] for c in cols], [int(x[-1]) for x in leads], int(length[-1]) - 1
    if last is not None and (before or last[5][0]):
        can = min(last[2][0] - last[3][0], lead[1] - lead[2]) >= least_overlap(int(last[2][0]), lead[1])
        yield out(last, np.array([lead[0]]) if can else last[1], np.array([True]))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([set_id(s) for s in found], pa.int64()),
                pa.array([len(s) for s in found], pa.int32()),
                pa.array([s.tobytes() for s in found], pa.binary()),
                pa.array([np.sort(s.astype(np.uint16)).tobytes() for s in found], pa.binary()),
            ],
            names=["sid", "n", "tokens", "short"],
        )


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common = [
            len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(common, pa.int64()), batch.column(4), batch.column(5)],
            names=["a", "b", "common", "n_a", "n_b"],
        )


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multiset intersections of tokens cut to 16 bits: equal tokens stay equal, so never less than the real ones."""
    for batch in batches:
        most = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            u, k = np.unique(np.frombuffer(x, np.uint16), return_counts=True)
            v, m = np.unique(np.frombuffer(y, np.uint16), return_counts=True)
            _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
            most.append(int(np.minimum(k[i], m[j]).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(most, pa.int64()), batch.column(4), batch.column(5)],
            names=["a", "b", "common", "n_a", "n_b"],
        )


def block_pairs(g: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one list's groups, in order of (low, -reach): indices of ``(later, earlier)``.

    ``low`` and ``high`` are a group's sizes and ``reach`` the most shingles that any member
    has left from its position on. Groups of one ``low`` are a block.
    """
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    ends = np.concatenate([starts[1:], [len(low)]])
    top = np.maximum.reduceat(high, starts)
    sizes = low[starts]
    for i in range(1, len(g)):
        need = least_overlap(low[i], sizes)
        fit = (100 * top >= PERCENT * low[i]) & (need <= reach[i]) & (starts < i)
        for k in np.flatnonzero(fit):
            a, b = starts[k], min(ends[k], i)
            b = a + np.searchsorted(-reach[a:b], -need[k], side="right")  # the block's rest is skipped
            other = np.arange(a, b)
            other = other[(c[a:b] != c[i]) & (100 * high[a:b] >= PERCENT * low[i])]
            if len(other):
                yield np.full(len(other), i), other


def _group_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of groups, in order of (token, low, -reach) -> pairs of groups of two components."""
    held: list[np.ndarray] | None = None

    def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token = cols[0]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        some: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for a, b in zip(first, [*first[1:], len(token)]):
            if b - a < 2:
                continue
            g = cols[1][a:b]
            for x, y in block_pairs(g, *(col[a:b] for col in cols[2:])):
                some.append((np.maximum(g[x], g[y]), np.minimum(g[x], g[y])))
                size += len(x)
                if size > 200_000:
                    yield batch_of(some)
                    some, size = [], 0
        if some:
            yield batch_of(some)

    def batch_of(some: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        both = np.unique(np.stack([np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(batch.num_columns)]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.flatnonzero(cols[0] == cols[0][-1])[0])  # the last list may go on
        held = [col[cut:] for col in cols]
        yield from pairs([col[:cut] for col in cols])
    if held is not None:
        yield from pairs(held)


def _cross_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (token, sid, n, pos, c) in order of token -> each with the entry before it that
    is of another component, if the two can reach the overlap: a pair per entry at most."""
    held: list[np.ndarray] = []  # the last entry, and the last one of another component than its own
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
        if held:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        token, sid, n, pos, c = cols
        m = len(token)
        at = np.arange(m)
        turn = np.concatenate([[False], c[1:] != c[:-1]])
        other = np.maximum.accumulate(np.where(turn, at - 1, -1))  # the last entry of the component run before
        ok = np.maximum(other, 0)
        fit = (other >= 0) & (token[ok] == token) & (100 * np.minimum(n, n[ok]) >= PERCENT * np.maximum(n, n[ok]))
        fit &= np.minimum(n - pos, n[ok] - pos[ok]) >= least_overlap(n, n[ok])
        fit[: len(held[0]) if held else 0] = False
        a, b = sid[fit], sid[ok[fit]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])
        keep = [m - 1] if other[-1] < 0 else [int(other[-1]), m - 1]
        held = [x[keep] for x in cols]


def overlaps(pairs: DataFrame, sets: DataFrame, exact: bool = True) -> DataFrame:
    """Intersection sizes of distinct pairs ``(a, b)``: ``(a, b, common, n_a, n_b)``; if not exact, upper
    bounds from a quarter of the bytes."""
    column, how = ("tokens", _overlaps) if exact else ("short", _bounds)
    a = sets.select(F.col("sid").alias("a"), F.col(column).alias("x"), F.col("n").alias("n_a"))
    b = sets.select(F.col("sid").alias("b"), F.col(column).alias("y"), F.col("n").alias("n_b"))
    # The leaders (b) have many partners: their sets come to the pairs last.
    wide = pairs.join(a, "a").join(b, "b")
    return wide.select("a", "b", "x", "y", "n_a", "n_b").mapInArrow(how, "a long, b long, common long, n_a int, n_b int")


def _similar() -> Column:
    return F.col("common") * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT


def _count(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def _tokens_in(of: np.ndarray, some: np.ndarray) -> int:
    """How many of ``some`` are in ``of``; both are sorted and distinct."""
    if not len(of) or not len(some):
        return 0
    return int((of[np.minimum(np.searchsorted(of, some), len(of) - 1)] == some).sum())


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, g, tokens, the leader's) -> what a member has more and less than its leader."""
    for batch in batches:
        plus, minus = [], []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            plus.append(np.setdiff1d(x, y, assume_unique=True).tobytes())
            minus.append(np.setdiff1d(y, x, assume_unique=True).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(plus, pa.binary()), pa.array(minus, pa.binary())], names=["sid", "g", "plus", "minus"])


def member_link(a: np.ndarray, b: np.ndarray, xs: list[tuple[np.ndarray, np.ndarray]], ys: list[tuple[np.ndarray, np.ndarray]]) -> bool:
    """Whether a member of leader ``a`` and one of ``b`` are similar; members are what they have (more, less) than their leader.

    A member's answer is its leader's, less what it has lost of it, and more what it has of the rest."""
    common = _tokens_in(a, b)
    of_b = [common - _tokens_in(b, less) + _tokens_in(b, more) for more, less in xs]
    of_a = [common - _tokens_in(a, less) + _tokens_in(a, more) for more, less in ys]
    for (more_x, less_x), b_x in zip(xs, of_b):
        n_x, x = len(a) + len(more_x) - len(less_x), None
        for (more_y, less_y), a_y in zip(ys, of_a):
            need = least_overlap(n_x, len(b) + len(more_y) - len(less_y))
            if min(b_x + len(more_y), a_y + len(more_x)) < need:
                continue
            if x is None:
                x = np.union1d(np.setdiff1d(a, less_x, assume_unique=True), more_x)
            if b_x - _tokens_in(x, less_y) + _tokens_in(x, more_y) >= need:
                return True
    return False


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, tokens of a, of b, pieces of their members) -> the pairs that a member's link joins."""
    for batch in batches:
        found = []
        for a, b, x, y, xs, ys in zip(*(batch.column(k).to_pylist() for k in range(6))):
            members = [[(np.frombuffer(m["plus"], np.int64), np.frombuffer(m["minus"], np.int64)) for m in ms] for ms in (xs, ys)]
            if member_link(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), *members):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _member_links(pairs: DataFrame, member: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of leaders ``(a, b)``, no links themselves, whose groups a link between members joins."""
    leaders = pairs.select(F.col("a").alias("g")).unionAll(pairs.select(F.col("b").alias("g"))).distinct()
    inside = member.join(leaders, "g").select("sid", "g")
    of = lambda i, t: sets.select(F.col("sid").alias(i), F.col("tokens").alias(t))
    wide = inside.join(of("sid", "x"), "sid").join(of("g", "y"), "g").select("sid", "g", "x", "y")
    apart = written(wide.mapInArrow(_differences, "sid long, g long, plus binary, minus binary"), "differences")
    size = apart.groupBy("g").agg(F.count("*").alias("size"))
    piece = F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / PIECE))
    pieces = apart.join(size, "g").withColumn("piece", piece).groupBy("g", "piece").agg(F.collect_list(F.struct("plus", "minus")).alias("ms"))
    pieces = written(pieces, "pieces")
    side = lambda g, ms: pieces.select(F.col("g").alias(g), F.col("ms").alias(ms))
    rows = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").join(side("a", "xs"), "a").join(side("b", "ys"), "b")
    found = written(rows.select("a", "b", "x", "y", "xs", "ys").mapInArrow(_linked, "a long, b long").distinct(), "member-links")
    free(apart, pieces)
    return found


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """A text ``(text)`` for each row ``(doc_id, text_id, copies)``."""
    ids = ids.select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t"), "copies")
    ids = written(ids, "wanted", n=F.count(F.lit(1)), copies=F.max("copies"))
    many = (ids.measured["copies"] or 0) > 1
    side = F.broadcast(ids) if ids.measured["n"] <= BROADCAST_IDS else ids
    found = docs.join(side, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_id") == F.col("_t")))
    if many:  # equal rows
        once = found.where("copies > 1").dropDuplicates(["doc_id", "text_id"])
        found = found.where("copies = 1").unionAll(once)
    return found.select("text")


def _sieve(docs: DataFrame, hot_tokens: int, hot_count: int) -> tuple[DataFrame, DataFrame, Broadcast]:
    """``(digest, left, order)``: rows ``(doc_id, text_id, n, sid)`` of documents, a row ``(sid, n, doc_id, text_id, copies)``
    for each set that may be similar to another, and the frequent shingles with their counts."""
    spark = docs.sparkSession
    ddl = "key long, sid long, kind long, doc_id long, n long"
    rows = docs.select("doc_id", "text", "text_id").mapInArrow(_sampled, ddl)
    rows = rows.repartition("key").sortWithinPartitions("key", "kind", "sid").mapInArrow(_credited, ddl)
    both = written(rows, "sieve")
    digest = both.where(F.col("kind") == DOCUMENT).select("doc_id", F.col("key").alias("text_id"), "n", "sid")
    counts = both.where(F.col("kind") == COUNT).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_count)
    top = sorted(tuple(r) for r in counts.orderBy(F.col("n").desc(), "key").limit(hot_tokens).collect())
    order = spark.sparkContext.broadcast((np.array([t for t, _ in top], np.int64), np.array([n for _, n in top], np.int64)))
    credits = both.where(F.col("kind") == CREDITS).groupBy("sid").agg(F.sum("n").alias("credits"))
    texts = digest.where("n > 0").groupBy("sid", "n", "doc_id", "text_id").agg(F.count("*").alias("copies"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")
    classes = texts.groupBy("sid", "n").agg(F.min_by(F.struct("doc_id", "text_id", "copies"), rank).alias("t"))
    least = F.expr(f"n - (n * {PERCENT} + 99) div 100 + 1")
    smallest = classes.withColumn("n0", F.col("n")).withColumn("n", F.expr(f"(n * {PERCENT} + 99) div 100"))
    shared = smallest.withColumn("l", F.floor((least - 1) / SAMPLE) + 1)
    left = shared.join(credits, "sid").where("credits >= l").select("sid", F.col("n0").alias("n"), "t.doc_id", "t.text_id", "t.copies")
    return digest, written(left, "left"), order


def _prefix_lists(texts: DataFrame, order: Broadcast, long_list: int) -> DataFrame:
    """Entries ``(token, sid, n, pos, lead)`` of the lists of prefix shingles, each with its leader."""
    rows = texts.mapInArrow(_tokens(order), "key long, token long, sid long, n long, df long")
    rows = rows.repartition("key").sortWithinPartitions("key", "token", "sid").mapInArrow(_counted, "sid long, token long, n long, df long")
    w = W.partitionBy("sid")
    at = F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("df", "token")) - 1
    entries = rows.withColumn("pos", at).where(F.col("pos") <= F.col("n") - F.expr(f"(n * {PERCENT} + 99) div 100"))
    parts = F.expr(f"1 + df div {long_list}")
    placed = entries.withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("sid"), parts) + 1).otherwise(0))
    named = placed.withColumn("list", F.when(F.col("part") > 0, F.xxhash64("token", "part")).otherwise(F.col("token")))
    ordered = named.repartition("list").sortWithinPartitions("list", "n", "pos", "sid").select("list", "sid", "n", "pos", "token", "part")
    return written(ordered.mapInArrow(_lists, "token long, sid long, n int, pos int, lead long"), "lists")


def find_components(docs: DataFrame, hot_tokens: int = HOT_TOKENS, long_list: int = LONG_LIST, rounds: int = LINK_ROUNDS, hot_count: int = HOT_COUNT) -> tuple[DataFrame, DataFrame]:
    """``(digest, roots)``: rows ``(doc_id, text_id, n, sid)`` of documents, and ``(id, root)`` of the
    sets that are linked with another set and are not the root themselves."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_id"))
    digest, left, order = _sieve(docs, hot_tokens, hot_count)
    lists = _prefix_lists(_texts_of(docs, left), order, long_list)
    listed = lists.select("sid").distinct()
    found = _texts_of(docs, left.join(listed, "sid", "left_semi"))
    sets = written(found.mapInArrow(_sets, "sid long, n int, tokens binary, short binary"), "sets")
    free(left)
    # Each set with the two leaders that it shares most prefix shingles with; what follows sees to all others.
    shared = lists.where("sid <> lead").groupBy("sid", "lead").agg(F.count("*").alias("k"))
    rank = F.struct("k", "lead")
    top = shared.groupBy("sid").agg(F.max(rank).alias("b1"))
    second = shared.join(top, "sid").where("lead <> b1.lead").groupBy("sid").agg(F.max(rank).alias("b2"))
    pairs = top.select(F.col("sid").alias("a"), F.col("b1.lead").alias("b")).unionAll(second.select(F.col("sid").alias("a"), F.col("b2.lead").alias("b")))
    tried = written(overlaps(pairs, sets), "tried")
    # Pairs known and found are one table each, so plans do not grow with the rounds.
    stars = written(tried.where(_similar()), "stars")
    known = written(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "known-pairs")
    free(tried)
    roots = components(stars.select("a", "b"))
    for k in range(rounds):
        seen = written(_checked(_next_pairs(lists, roots, known, k), sets), "round-links", found=_count(_similar()))
        new = seen.where(_similar())
        if not seen.measured["found"]:
            break
        before = known, stars
        known = written(known.unionAll(seen.select("a", "b")), "known-pairs")
        stars = written(stars.unionAll(new), "stars")
        roots = extended(roots, new.select("a", "b"))
        free(*before, seen)
    links = _group_links(lists, stars, roots, sets)
    if links is not None and links.measured["n"]:
        roots = extended(roots, links)
    free(lists, sets, known, stars)
    return digest, roots


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``overlaps`` of pairs: bounds first, and the exact sizes of what may be similar. The others' bounds are enough to refute them."""
    bound = written(overlaps(pairs, sets, exact=False), "bounds")
    return bound.where(~_similar()).unionAll(overlaps(bound.where(_similar()).select("a", "b"), sets))


def _mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of the lists that hold two components or more, with their component ``c``."""
    placed = lists.join(roots.withColumnRenamed("id", "sid"), "sid", "left").select("token", "sid", "n", "pos", F.coalesce("root", "sid").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("token")
    return placed.join(mixed, "token", "left_semi")


def _next_pairs(lists: DataFrame, roots: DataFrame, tried: DataFrame, turn: int) -> DataFrame:
    """Pairs of sets of two components that have not been tried: of each set at most the ``PARTNERS`` that share most prefix shingles
    with it. The others' turn comes in later rounds and in the pass over groups. Every turn orders the sets anew, so each
    entry of a component meets others; entries so late in their sets that few partners are left to them stand back."""
    early = (F.col("n") - F.col("pos")) * (100 + PERCENT) >= F.col("n") * (2 * PERCENT)
    ordered = _mixed(lists.where(early), roots).withColumn("at", F.xxhash64("sid", F.lit(turn))).repartition("token").sortWithinPartitions("token", "at", "sid").drop("at")
    pairs = ordered.mapInArrow(_cross_links, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("k"))
    pairs = pairs.join(tried, ["a", "b"], "left_anti")  # a is the greater in both
    w = W.partitionBy("a").orderBy(F.col("k").desc(), "b")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= PARTNERS).select("a", "b")


def _group_links(lists: DataFrame, stars: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links ``(a, b)`` between sets, or between leaders for their groups, that join what are still two components."""
    mixed = written(_mixed(lists, roots), "mixed", n=_count())
    if not mixed.measured["n"]:
        return None
    # Groups: each set under one similar leader, one with many partners. Each step is a table, so no plan holds those before it twice.
    both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b"), "common", F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
    degree = written(both.groupBy(F.col("b").alias("_d")).agg(F.count("*").alias("degree")), "degrees")
    rank = F.struct("degree", "b")
    mine = degree.select(F.col("_d").alias("a"), F.struct("degree", F.col("_d").alias("b")).alias("own"))
    led = both.join(degree, F.col("b") == F.col("_d")).join(mine, "a").where(F.struct("degree", "b") > F.col("own"))
    led = written(led.select("a", "b", "common", "degree"), "led")
    # Leaders are the sets that no partner outranks; the others join their highest partner that leads.
    below = led.select(F.col("a").alias("_t")).distinct()
    group = led.join(below, F.col("b") == F.col("_t"), "left_anti").groupBy(F.col("a").alias("sid")).agg(F.max_by(F.struct("b", "common"), rank).alias("g"))
    member = (
        sets.select("sid", "n")
        .join(group, "sid", "left")
        .select("sid", "n", F.coalesce("g.b", "sid").alias("g"), (F.col("n") - F.coalesce("g.common", "n")).alias("apart"))
    )
    member = written(member, "members")
    free(degree, led)
    by_group = (
        mixed.join(member.select("sid", "g"), "sid")
        .groupBy("token", "g", "c")
        .agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("reach"))
    )
    ordered = (
        by_group.repartition("token")
        .sortWithinPartitions("token", "low", F.col("reach").desc(), "g")
        .select("token", "g", *[F.col(c).cast("long").alias(c) for c in ("c", "low", "high", "reach")])
    )
    pairs = written(ordered.mapInArrow(_group_pairs, "a long, b long").distinct(), "group-pairs")
    known = written(_checked(pairs, sets), "known")
    links = known.where(_similar()).select("a", "b")
    # What is left: no link of the leaders, but their members may reach.
    groups = member.groupBy("g").agg(F.min("n").alias("low"), F.max("apart").alias("apart"))
    open_pairs = (
        known.where(~_similar())
        .join(groups.select(F.col("g").alias("a"), F.col("low").alias("low_a"), F.col("apart").alias("ap_a")), "a")
        .join(groups.select(F.col("g").alias("b"), F.col("low").alias("low_b"), F.col("apart").alias("ap_b")), "b")
        .where(
            (F.col("ap_a") + F.col("ap_b") > 0)
            & ((F.col("common") + F.col("ap_a") + F.col("ap_b")) * (100 + PERCENT) >= (F.col("low_a") + F.col("low_b")) * PERCENT)
        )
        .select("a", "b")
    )
    open_pairs = written(open_pairs, "open-pairs", n=_count())
    if open_pairs.measured["n"]:
        links = links.unionAll(_member_links(open_pairs, member, sets))
    links = written(links.distinct(), "links", n=_count())
    free(mixed, member, pairs, known, open_pairs)
    return links


def report(docs: DataFrame, **options) -> DataFrame:
    """A row per document: ``doc_id, n_shingles, component_id``."""
    digest, roots = find_components(docs, **options)
    placed = digest.where("n > 0").join(roots.withColumnRenamed("id", "sid"), "sid", "left")
    placed = placed.select("doc_id", "n", "sid", F.coalesce("root", "sid").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    full = placed.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = digest.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionAll(empty)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of every component: of smallest doc_id, nulls last, then of least text hash.

    A document is a doc_id and a text, so others of the same doc_id, or without one, are untouched. Equal
    documents are kept once; wordless ones all stay."""
    digest, roots = find_components(docs.select("doc_id", "text"), **options)
    placed = digest.where("n > 0").join(roots.withColumnRenamed("id", "sid"), "sid", "left")
    placed = written(placed.select("doc_id", "text_id", F.coalesce("root", "sid").alias("root")), "placed")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")
    best = placed.groupBy("root").agg(F.min(rank).alias("x")).select(F.col("x.doc_id").alias("_d"), F.col("x.text_id").alias("_t"))
    best = written(best, "best")

    def of(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_id") == F.col("_t")), how)

    def keys_of(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        found = written(rows.select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")), name, n=_count())
        n = found.measured["n"]
        return (F.broadcast(found) if n <= BROADCAST_IDS else found), n

    counts = placed.groupBy("doc_id", "text_id").agg(F.count("*").alias("k"))
    drop, _ = keys_of(of(counts, best, "left_anti"), "drop")
    twice, again = keys_of(of(counts.where("k > 1"), best, "left_semi"), "twice")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rest = of(packed, drop, "left_anti")
    if again:
        rest = of(rest, twice, "left_anti").unionAll(of(rest, twice, "left_semi").dropDuplicates(["doc_id", "text_id"]))
    return rest.select("doc.*")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
