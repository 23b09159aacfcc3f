"""Operator 8: exact token counts at every prefix.

Within one pre-token, a byte-pair encoding is valid exactly when each
neighbouring pair of its tokens is: merging the two texts afresh gives back the two
tokens. So the encoding of a prefix ends in the one vocabulary token that fits behind
the encoding of what is before it. The dynamic program keeps, for every prefix, its last token and its
count, and one pass over the pre-token gives the exact counts of all its prefixes.
This vocabulary marks word ends, so each prefix has two states: the word may go
on (``open``), or it ends here (``closed``, counted with the end mark).

The pre-tokenizer drops white space and never crosses it, so a text's
counts are the running sum over its space-separated pieces; a piece's table is kept in a
bounded cache. ``Prefixes`` answers counts, truncation and budgets from the stored
counts without encoding again. Pieces where a longer prefix may change how a
shorter one is split (apostrophes, added tokens, letters that normalisation changes
in number) take their inner counts from the library, prefix by prefix.

Defined cases: a null or empty text has 0 bytes and 0 tokens; equal rows and ties are
counted each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.llm.common import small_batches, table
from datastrata.llm.token_output import tokenizer_path

MAX_TOKENS = 2048
PIECES = 800_000
PAIRS = 1_000_000


class WordDP:
    """The program over one pre-token, given as the library's symbols.

    Tokens are numbered by the rank of the merge that makes them, plain symbols
    first. Two neighbours are a valid pair if undoing their merges, latest first, never
    meets a merge across their border that byte-pair encoding would have done sooner.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        base = len(model["vocab"])
        made: dict[str, tuple[int, str, str]] = {}
        for i, (a, b) in enumerate(merges):
            made.setdefault(a + b, (base + i, a, b))
        whole = [t for t in model["vocab"] if len(self.merged(self.symbols(t))) == 1]
        number = {t: made[t][0] if t in made else k for k, t in enumerate(model["vocab"])}
        self.halves = {number[t]: (number[made[t][1]], number[made[t][2]]) if t in made else (number[t],) * 2 for t in number}
        self.pairs = {(number[a], number[b]): base + i for i, (a, b) in enumerate(merges)}
        self.open = {t: number[t] for t in whole if not t.endswith(end)}
        self.closed = {t[: -len(end)]: number[t] for t in whole if t.endswith(end) and t != end}
        self.longest = max(map(len, [*self.open, *self.closed]))
        self.fits: dict[tuple[int, int], bool] = {}

    def symbols(self, token: str) -> list[str]:
        """The characters of a token, its end mark joined to the last."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Byte-pair encoding by its definition."""
        parts = list(parts)
        rank, none = self.rank, len(self.rank)
        while len(parts) > 1:
            best, i = min((rank.get(pair, none), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if best == none:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        halves, pairs = self.halves, self.pairs
        soonest = 1 << 60
        while True:
            if pairs.get((a, b), soonest) < soonest:
                return False
            inner, outer = halves[a][1], halves[b][0]
            if inner == a and outer == b:
                return True
            if outer == b or (a > b and inner != a):
                soonest, a = a, inner
            else:
                soonest, b = b + 1, outer

    def fitting(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.fit(a, b)
        return known

    def going(self, word: str) -> tuple[list[int], list[int]]:
        """For each proper prefix, as a word that goes on: its last token and its count."""
        last, count = [-1], [0]
        vocab, longest, fits, fitting = self.open, self.longest, self.fits, self.fitting
        for i in range(1, len(word)):
            t = vocab.get(word[:i]) if i <= longest else None
            if t is not None:
                last.append(t)
                count.append(1)
                continue
            for j in range(max(1, i - longest), i):
                t = vocab.get(word[j:i])
                if t is not None:
                    a = last[j]
                    ok = fits.get((a, t))
                    if ok or (ok is None and fitting(a, t)):
                        last.append(t)
                        count.append(count[j] + 1)
                        break
        return last, count

    def ended(self, word: str, i: int, last: list[int], count: list[int]) -> int:
        """Count of ``word[:i]`` as a whole word, from the stored prefixes."""
        vocab, longest = self.closed, self.longest
        if word[:i] in vocab:
            return 1
        for j in range(max(1, i - longest), i):
            t = vocab.get(word[j:i])
            if t is not None and self.fitting(last[j], t):
                return count[j] + 1
        raise AssertionError("every symbol is a token")

    def total(self, word: str) -> int:
        if word in self.closed:
            return 1
        return self.ended(word, len(word), *self.going(word))

    def counts(self, word: str) -> list[int]:
        """Token count of ``word[:k]`` as a word of its own, for k from 1 on."""
        stored = self.going(word)
        return [self.ended(word, i, *stored) for i in range(1, len(word) + 1)]


#: How this tokenizer splits pieces of plain characters, and the bytes that its byte alphabet shows as themselves.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
SHOWN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def byte_alphabet() -> dict[int, str]:
    """Bytes to the characters that stand for them: itself, or the next free one from 256."""
    hidden = [b for b in range(256) if b not in SHOWN]
    return {b: chr(b) for b in SHOWN} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PrefixCounter:
    def __init__(self, path: str, pieces: int = PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dp = WordDP(path)
        self.limit = pieces
        self.words: dict[str, int] = {}
        self.totals: dict[bytes, int] = {}
        shown = byte_alphabet()
        self.letters = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    def word(self, symbols: str) -> int:
        found = self.words.get(symbols)
        if found is None:
            if len(self.words) >= self.limit:
                self.words.clear()
            found = self.words[symbols] = self.dp.total(symbols)
        return found

    def split(self, piece: str) -> list[str]:
        """The pre-tokens of a piece, in the library's symbols."""
        if PLAIN.fullmatch(piece):
            found = SPLIT.findall(piece.lower())
            return found if piece.isascii() else [t.translate(self.letters) for t in found]
        normal = self.tokenizer.normalizer.normalize_str(piece)
        return [symbols for symbols, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def piece(self, piece: str) -> int:
        """Token count of a piece without white space around it."""
        if "<" in piece and any(a in piece for a in self.added):
            return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return sum(map(self.word, self.split(piece)))

    def inner(self, piece: str) -> list[int]:
        """Counts of ``piece[:k]`` for k from 1 on."""
        if "'" in piece or "<" in piece or not piece.isascii():
            return [len(self.tokenizer.encode(piece[:k], add_special_tokens=False).ids) for k in range(1, len(piece) + 1)]
        out, before = [], 0
        for symbols in self.split(piece):
            counts = self.dp.counts(symbols)
            out += [before + c for c in counts]
            before += counts[-1]
        return out

    def counts(self, texts: list[bytes]) -> list[list[int]]:
        """For each text in UTF-8, the running counts after each of its pieces."""
        split = [t.split() for t in texts]
        known = self.totals
        used = set().union(*split)
        fresh = used.difference(known)
        if len(known) + len(fresh) > self.limit:
            known.clear()
            fresh = used
        for p in fresh:
            known[p] = self.piece(p.decode("utf-8"))
        return [list(accumulate(map(known.__getitem__, pieces))) for pieces in split]


class Prefixes:
    """The stored counts of one text; answers without encoding it again."""

    def __init__(self, counter: PrefixCounter, text: str):
        raw = text.encode("utf-8")
        self.after = counter.counts([raw])[0]
        self.at = [0]
        place, inside = 0, False
        self.pieces: list[tuple[int, int]] = []
        for k, c in enumerate(text):
            space = c in " \t\n\r\x0b\x0c"
            if not space and not inside:
                place = k
            if space and inside:
                self.pieces.append((place, k))
            inside = not space
        if inside:
            self.pieces.append((place, len(text)))
        before = 0
        for (a, b), total in zip(self.pieces, self.after):
            self.at += [before] * (a - len(self.at) + 1)
            self.at += [before + c for c in counter.inner(text[a:b])]
            before = total
        self.at += [before] * (len(text) + 1 - len(self.at))

    def count(self, k: int | None = None) -> int:
        """Tokens of the first ``k`` characters; of all by default."""
        return self.at[-1 if k is None else k]

    def truncate(self, budget: int) -> int:
        """The largest number of characters of whole pieces within ``budget`` tokens."""
        i = bisect.bisect_right(self.after, budget)
        return self.pieces[i - 1][1] if i else 0


@lru_cache(maxsize=1)
def worker_counter(path: str) -> PrefixCounter:
    """One counter for all tasks of a Python worker, so its tables live on."""
    return PrefixCounter(path)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = counter.counts([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t or b"") for t in texts], pa.int64()),
                    pa.array([c[-1] if c else 0 for c in found], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = d.mapInArrow(_count(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
