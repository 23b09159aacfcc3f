"""Operator 7: token ids as bit-packed binary output.

Documents are range-partitioned and sorted by doc_id, encoded, ended by an end id, and
packed (see ``bitpack``) into files of about ``FILE_IDS`` ids that hold whole
documents. A file is one row, of about a megabyte, of an uncompressed Parquet table in the shared folder, so it is written by
Spark's commit protocol: a retried or lost task leaves no half-written file, and any
store that Spark can write to will do. Each row says where its ids start within its
partition; the start of a partition is a running sum over one row per partition, which is
the only thing broadcast.

Encoding. The pre-tokenizer never joins a non-space character with a single
space after it, so a text falls apart at such spaces into pieces that the library encodes
independently; it also cuts a word of letters from the marks that follow it, so commas and full stops before a space are made pieces of their own, unless what
precedes them is no letter. Each worker keeps the library's ids of pieces it has seen, within a
bounded table; new pieces go to the library as the lines of one text. Texts with runs of
spaces, or space at an end, go to the library whole.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; rows of
equal doc_id follow in the order of their text's hash; equal rows each have their own place; an
empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datastrata.llm.bitpack import TokenFile, encode_file, width
from datastrata.llm.common import scratch_path, small_batches, table

END_ID = 0
FILE_IDS = 1 << 19
PIECES = 900_000
#: What the pre-tokenizer cuts off a word that it follows, as one piece.
MARKS = ".,;:!?$#%&*()"


#: Marks that are cut off before texts are split, and what a piece of marks alone begins with after that.
CUT_MARKS, CUT = (",", "."), "\0"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_marks(texts: list[str]) -> pa.Array:
    """Texts in which a mark that a space follows is a piece of its own."""
    cut = pa.array(texts, pa.large_string())
    for mark in CUT_MARKS:
        cut = pc.replace_substring(cut, f"{mark} ", f" {CUT}{mark} ")
    return cut


def split_pieces(texts: list[str] | pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces between single spaces, the place of each text's pieces among them, and where each text's begin, with the end."""
    lists = pc.split_pattern(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), " ")
    values = lists.values.dictionary_encode()
    return values.dictionary.to_pylist(), values.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)


def join_pieces(cells: list[bytes], places: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """The ids of ``cells`` at ``places``, for each text."""
    flat, size = np.frombuffer(b"".join(cells), "<u4"), np.fromiter(map(len, cells), np.int64, len(cells)) // 4
    start, n = (np.cumsum(size) - size)[places], size[places]
    ends = np.cumsum(n)
    ids = flat[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    cut = np.concatenate([[0], ends])[begins].tolist()
    return [ids[a:b] for a, b in zip(cut, cut[1:])]


class PieceEncoder:
    """The library's ids of whole texts, by way of a table of pieces."""

    def __init__(self, path: str, pieces: int = PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.limit = pieces
        (self.newline,) = self._library(["\n"])
        self.line_id = int(np.frombuffer(self.newline, "<u4")[0])
        #: ids of a piece after one space, and at a line's or text's start; None: not by pieces
        self.spaced: dict[str, bytes | None] = {}
        self.bare: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _lines(self, pieces: list[str], lead: str, known: dict[str, bytes | None]) -> None:
        """Encode pieces without line ends by one call each few thousand, a line each."""
        for k in range(0, len(pieces), 4096):
            some = pieces[k : k + 4096]
            (raw,) = self._library([lead + ("\n" + lead).join(some)])
            ends = (np.flatnonzero(np.frombuffer(raw, "<u4") == self.line_id) * 4).tolist()
            known.update(zip(some, [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)])]))

    def _learn(self, missing: set[str]) -> None:
        fresh, lines, heads = [], [], []
        for p in missing:
            if not p or p[0].isspace() or p[-1].isspace():
                self.spaced[p] = None
            elif "\n" not in p:
                fresh.append(p)
            elif any(not q or q[0].isspace() or q[-1].isspace() for q in p.split("\n")):
                self.spaced[p] = self._library([" " + p])[0]
            else:
                first, *rest = p.split("\n")
                lines.append((p, first, rest))
                heads.append(first)
        fresh += {q for q in heads if q not in self.spaced and q not in missing}
        self._lines(fresh, " ", self.spaced)
        self._lines(list({q for *_, rest in lines for q in rest if q not in self.bare}), "", self.bare)
        for p, first, rest in lines:
            self.spaced[p] = self.newline.join([self.spaced[first], *(self.bare[q] for q in rest)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, for each text."""
        return self._encode(texts, True) if texts else []

    def _encode(self, texts: list[str], cut: bool) -> list[bytes]:
        found, places, begins = split_pieces(cut_marks(texts) if cut else texts)
        begin = begins[:-1]
        later = np.ones(len(places), bool)
        later[begin] = False
        after = np.zeros(len(found), bool)
        after[places[later]] = True
        marks = {found.index(CUT + m): self._marks(m) for m in CUT_MARKS if CUT + m in found} if cut else {}
        after[list(marks)] = False
        is_after = after.tolist()
        cells = self.known([p for p, a in zip(found, is_after) if a])
        firsts = [found[k] for k in places[begin].tolist()]
        heads = {p for p in firsts if p and "\n" not in p and not p[0].isspace() and not p[-1].isspace()}
        self._lines([p for p in heads if p not in self.bare], "", self.bare)
        uncut = self._uncut(texts, found, places, begin, list(marks)) if cut else []
        alone = np.array([c is None for c in cells] + [p not in heads for p in firsts] + [False] * len(marks))
        number = np.cumsum(after) - 1
        number[list(marks)] = len(cells) + len(texts) + np.arange(len(marks))
        places = number[places]
        places[begin] = len(cells) + np.arange(len(texts))
        whole = np.logical_or.reduceat(alone[places], begin)
        whole[uncut] = False
        whole = np.flatnonzero(whole).tolist()
        joined = join_pieces([c or b"" for c in cells] + [self.bare[p] if p in heads else b"" for p in firsts] + list(marks.values()), places, begins)
        out = [ids.tobytes() for ids in joined]
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        for i, ids in zip(uncut, self._encode([texts[i] for i in uncut], False) if uncut else []):
            out[i] = ids
        return out

    @staticmethod
    def _uncut(texts: list[str], found: list[str], places: np.ndarray, begin: np.ndarray, marks: list[int]) -> list[int]:
        """The texts to be split without a cut: the pre-tokenizer cuts marks off letters alone, and ``CUT`` may be a text's own."""
        at = np.flatnonzero(np.isin(places, marks))
        letters = np.zeros(len(found), bool)
        before = places[at - 1]
        for k in np.unique(before).tolist():
            letters[k] = found[k][-1:].isalpha()
        bad = np.searchsorted(begin, at[~letters[before]], side="right") - 1
        return sorted({*bad.tolist(), *(i for i, t in enumerate(texts) if CUT in t)})

    def known(self, used: list[str]) -> list[bytes | None]:
        """Ids of distinct pieces after one space; None: not by pieces."""
        cells = list(map(self.spaced.get, used, repeat(False)))
        new = [i for i, c in enumerate(cells) if c is False]
        # A word and the marks after it are cut apart before anything else, so they are encoded, and kept, alone.
        words = [used[i].rstrip(MARKS) for i in new]
        words = [w if w.isalpha() else used[i] for i, w in zip(new, words)]
        missing = {w for w in words if w not in self.spaced}
        if len(self.spaced) + len(missing) > self.limit or len(self.bare) > self.limit:
            self.spaced.clear()
            self.bare.clear()
            missing = set(words)
        self._learn(missing)
        for i, w in zip(new, words):
            p, ids = used[i], self.spaced[w]
            cells[i] = ids if len(p) == len(w) else ids + self._marks(p[len(w) :])
        return cells

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > self.limit:
                self.marks.clear()
            self.marks[marks] = self._library([marks])[0]
        return self.marks[marks]


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> PieceEncoder:
    """One encoder for all tasks of a Python worker, so its table of pieces lives on."""
    return PieceEncoder(path)


def _pack(path: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        bits = width(encoder.vocab_size)
        end = np.array([end_id], dtype="<u4").tobytes()
        part, offset, names, chunks, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal offset, names, chunks, held
            ids = np.frombuffer(b"".join(chunks), dtype="<u4")
            ends = np.cumsum([len(c) // 4 for c in chunks])
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "part_offset": [offset], "n_ids": [len(ids)], "data": [encode_file(ids, ends, names, bits)]},
                schema=pa.schema([("part", pa.int32()), ("part_offset", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]),
            )
            offset += len(ids)
            names, chunks, held = [], [], 0
            return row

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in zip(docs, encoder.encode([t or "" for t in texts])):
                names.append(doc)
                chunks.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= file_ids:
                    yield flush()
        if names:
            yield flush()

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Write ``(doc_id, text)`` to a table of files at ``out``."""
    small_batches(docs.sparkSession)
    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text"))
    ranged = order.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    rows = ranged.select("doc_id", "text").mapInArrow(
        _pack(tokenizer, end_id, file_ids), "part int, part_offset long, n_ids long, data binary"
    )
    rows.write.option("compression", "uncompressed").parquet(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            f = TokenFile(data)
            ids = f.ids().astype("<u4")
            begins = np.concatenate([[0], f.ends[:-1]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(f.doc_ids, pa.int64()),
                    pa.array(begins + start, pa.int64()),
                    pa.array(f.ends - begins, pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, f.ends)], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """A row per document of the files at ``out``: its place, length and checksum."""
    files = spark.read.schema("part int, part_offset long, n_ids long, data binary").parquet(out)
    starts = (
        files.groupBy(F.col("part").alias("_p"))
        .agg(F.sum("n_ids").alias("_n"))
        .select(
            "_p",
            F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"),
        )
    )
    # One row per output partition: thousands at most, whatever the input.
    placed = files.join(F.broadcast(starts), F.col("part") == F.col("_p"))
    return placed.select((F.col("_s") + F.col("part_offset")).cast("long").alias("start"), "data").mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


def token_output(docs: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    spark = docs.sparkSession
    out = scratch_path(spark, "token-files")
    write_token_files(docs.select("doc_id", "text"), out, tokenizer_path(name))
    return read_token_files(spark, out)
