"""Operator 4: secret scans.

DataFrame functions only; nothing is shuffled. Patterns give the base spans. Places are
found by splitting the text at the pattern: a match starts where the pieces and
matches before it end, counted in code points by running sums in blocks, so texts of tens of thousands of matches take seconds.

The method: candidates are runs of 20 characters or more of the base64 alphabet;
those of hex digits alone are of class hex, the others of class base64. A window of
20 characters slides along a candidate. The state of the fold is the count of each symbol of
the class's alphabet and the sum of ``c * log2(c)``; a step takes one symbol out and one
in, so only two terms change. A candidate's entropy is that of its best window. It is
reported if this reaches its class's threshold, unless it is on the allow list or overlaps a
base span. Base64 candidates need a digit and both cases, which running words lack.

Allow list: runs made of a known placeholder word, counting alphabets, and UUIDs, which are
identifiers rather than secrets. It never touches base spans.

Defined cases: a null or empty text has no span; equal rows get equal results; a null
doc_id is kept; spans of equal start go in the order of ``KINDS``; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.llm.common import table

#: The base patterns.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_VALUE = 8
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Numbers of an array that are folded at once.
BLOCK = 128
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {"hex": "0123456789abcdef", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"}
#: Bits per character of a window: random hex has about 3.5, random base64 about 4.1, prose 3.5 or less.
THRESHOLDS = {"hex": 3.2, "base64": 3.9}
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[-_]|xxxx|abcdefghij|0123456789"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often, and in whatever lambda, it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, op: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """Running results of an associative operation on numbers of 0 or more, whose result for 0 and x is x. An array is folded in blocks, whose own results
    come first and whose ends then go on to the next, so no append copies more than a block or the list of blocks."""
    none = F.array().cast(f"array<{kind}>")

    def append(acc: Column, x: Column) -> Column:
        return _let(op(acc["last"], x), lambda now: F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out")))

    def folded(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).cast(kind).alias("last"), none.alias("out")), append)

    def joined(blocks: Column) -> Column:
        before = folded(F.transform(blocks, lambda b: b["last"]))["out"]
        return _let(before, lambda ends: F.flatten(F.transform(blocks, lambda b, i: _let(F.coalesce(F.get(ends, i - 1), F.lit(0).cast(kind)), lambda low: F.transform(b["out"], lambda x: op(low, x))))))

    starts = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
    cut = lambda v: F.transform(starts(v), lambda k: folded(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))
    return _let(values, lambda v: F.when(F.size(v) > 0, _let(cut(v), joined)).otherwise(none))


def _matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern as ``array<struct<s, e, m>>``, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct((F.length(g) + F.coalesce(F.length(m), F.lit(0))).alias("n"), m.alias("m")))
    placed = lambda z: F.zip_with(
        z, _running(F.transform(z, lambda x: x["n"]), lambda a, b: a + b), lambda x, e: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m"))
    )
    return F.filter(_let(pieces, placed), lambda x: x["m"].isNotNull())


def _apart(runs: Column, base: Column) -> Column:
    """Those of ``runs`` that overlap no span of ``base``, which is in order of starts: of the spans that start before a run's end, found by
    halving, none may end after its start."""

    def free(sides: Column) -> Column:
        def before(x: Column) -> Column:
            step = lambda k, p: F.when(F.get(sides["s"], k + p - 1) < x["e"], k + p).otherwise(k)
            return F.aggregate(F.array(*[F.lit(1 << p) for p in reversed(range(25))]), F.lit(0), step)

        return F.filter(runs, lambda x: _let(before(x), lambda k: (k == 0) | (F.coalesce(F.get(sides["e"], k - 1), F.lit(0)) <= x["s"])))

    sides = lambda b: F.struct(F.transform(b, lambda x: x["s"]).alias("s"), _running(F.transform(b, lambda x: x["e"]), F.greatest).alias("e"))
    return _let(_let(base, sides), free)


def _term(count: Column) -> Column:
    """``c * log2(c)``, 0 for 0."""
    return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))


def window_entropy(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Most bits per character of any window; null for shorter texts."""
    letters = F.lit(alphabet)
    at = lambda k: F.instr(letters, F.substr(text, k, F.lit(1))) - 1
    head = F.sequence(F.lit(1), F.lit(window))
    first = F.transform(
        F.sequence(F.lit(0), F.lit(len(alphabet) - 1)),
        lambda symbol: F.size(F.filter(head, lambda k: at(k) == symbol)),
    )
    start = F.aggregate(first, F.lit(0.0), lambda a, c: a + _term(c))

    def slide(acc: Column, k: Column) -> Column:
        gone, come = at(k), at(k + window)
        counts = acc["counts"]
        c_gone, c_come = F.get(counts, gone), F.get(counts, come)
        moved = F.when(gone == come, acc["sum"]).otherwise(
            acc["sum"] - _term(c_gone) + _term(c_gone - 1) - _term(c_come) + _term(c_come + 1)
        )
        after = F.transform(counts, lambda c, i: c - (i == gone).cast("int") + (i == come).cast("int"))
        return F.struct(after.alias("counts"), moved.alias("sum"), F.least(acc["least"], moved).alias("least"))

    state = F.struct(first.alias("counts"), start.alias("sum"), start.alias("least"))
    steps = F.when(F.length(text) > window, F.sequence(F.lit(1), F.length(text) - window)).otherwise(F.array().cast("array<int>"))
    least = F.aggregate(steps, state, slide, lambda acc: acc["least"])
    return F.when(F.length(text) >= window, F.lit(math.log2(window)) - least / window)


def _spans(kind: str, places: Column) -> Column:
    rank = KINDS.index(kind)
    return F.transform(places, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with ``base`` and ``found``: spans ``struct<s, k, e, kind>`` in order."""
    d = docs.select("doc_id", "text", F.coalesce("text", F.lit("")).alias("q_text"))
    # The value is group 2; a match without a long enough one is used up, but no span.
    sizes = F.transform(F.regexp_extract_all("q_text", F.lit(ASSIGN), F.lit(2)), F.length)
    valued = F.zip_with(_matches(F.col("q_text"), ASSIGN), sizes, lambda x, n: F.struct(x["s"].alias("s"), x["e"].alias("e"), n.alias("n")))
    d = d.withColumn("q_assign", F.filter(valued, lambda x: x["n"] >= ASSIGN_VALUE))
    d = d.withColumn("q_access", _matches(F.col("q_text"), ACCESS)).withColumn("q_hex", _matches(F.col("q_text"), HEX))
    d = d.withColumn(
        "base", F.array_sort(F.concat(*[_spans(k, F.col(f"q_{k}")) for k in ("assign", "access", "hex")]))
    )
    d = d.withColumn("q_runs", _matches(F.col("q_text"), CANDIDATE))
    d = d.withColumn("q_runs", F.filter(_apart(F.col("q_runs"), F.col("base")), lambda x: ~x["m"].rlike(ALLOWED)))
    is_hex = lambda x: x["m"].rlike("^[0-9a-fA-F]+$")
    mixed = lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[a-z]") & x["m"].rlike("[A-Z]")
    high = lambda x, kind, text: window_entropy(text, ALPHABETS[kind]) >= THRESHOLDS[kind]
    hexes = F.filter("q_runs", lambda x: is_hex(x) & high(x, "hex", F.lower(x["m"])))
    others = F.filter("q_runs", lambda x: ~is_hex(x) & mixed(x) & high(x, "base64", x["m"]))
    found = F.array_sort(F.concat("base", _spans("entropy_hex", hexes), _spans("entropy_base64", others)))
    return d.select("doc_id", "text", "base", found.alias("found"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return d.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )
