"""Token alignment, edit fingerprints and the filter audit: brute force on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from datastrata.llm import edit_fingerprint, filter_audit, token_alignment
from datastrata.llm.token_output import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, mask int, row long, fingerprint string, _range int"
LONG = " ".join(f"w{i * 7 % 1009}" for i in range(20_000))


def rows():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdeéñ漢🙂") for _ in range(rnd.randint(1, 8))) for _ in range(200)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = [(i, say(rnd.randint(1, 300)), rnd.choice(["en", "de", None, ""])) for i in range(80)]
    copied = say(250)
    out += [(100 + i, copied, "en") for i in range(40)]
    out += [(5, copied, "de"), (100, copied, "en"), (7, say(30), "en"), (None, copied, "en"), (None, say(3), None), (90, None, "en"), (91, "", "de")]
    out += [(92, LONG, "en"), (93, LONG + " end", "en"), (94, "<|endoftext|> a<s>b</s> ▁x", "en"), (95, " two  spaces\n\n\tand  tabs ", "en"), (96, "A" * 3000, "en"), (97, "#" + say(210), "en")]
    out += [(98, " ".join(["same", "words"] * 150), "de"), (-3, "\n", "en"), (-4, "x", "en")]
    return [(*r, 7, 8, "f", -1) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


def failing(text):
    words = WORD.findall(text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))]


def test_filter_audit(spark, docs):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 140, 3)] + [(3, 1, 1), (None, 1, 1), (100, None, 1), (5, 1, None)]
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    parts = collections.defaultdict(list)
    everything = [(d, t or "", p or "") for d, t, p, *_ in rows()]
    for d, t, p in everything:
        copied = d is not None and any(e is not None and e < d and u == t for e, u, _ in everything)
        parts[p].append((d, [*failing(t), copied]))
    want = set()
    for part, held in parts.items():
        steps = []
        for order in itertools.permutations(range(5)):
            left = held
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                all_failing = [x for x in held if x[1][f]]
                alone = [x for x in all_failing if sum(x[1]) == 1]
                steps.append((f, (part, "".join("ABCDE"[k] for k in order), step, len(left), len(gone), len(all_failing) - len(gone), len(alone), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))))
        total = collections.Counter()
        for f, row in steps:
            total[f] += row[4]
        want |= {(*row, total[f]) for f, row in steps}
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) == 600 * len(parts) and set(got) == want


def test_copies_whatever_is_held(docs):
    """Small memory sends each text several times; the failures stay the same."""
    whole = sorted(map(tuple, filter_audit.failures(docs).groupBy("doc_id", "part", "mask").sum("rows").collect()), key=repr)
    assert whole == sorted(map(tuple, filter_audit.failures(docs, held_bytes=100).groupBy("doc_id", "part", "mask").sum("rows").collect()), key=repr)
    ids = {r.doc_id for r in filter_audit.non_minimum_ids(docs).collect()}
    assert ids == {*range(100, 140), 91}


def test_collision_chains():
    """One fingerprint for all texts: each text of the chain has a minimum of its own."""
    run = filter_audit._chains(16)
    sent = [(1, ("a", 3, 0, [("en", 1)])), (1, ("b", 2, 0, [("en", 1)])), (1, ("a", 1, 0, [("en", 2)])), (1, ("b", 2, 0, [("de", 1)])), (2, (None, 9, 16, [("en", 1)]))]
    assert sorted(run(iter(sent))) == [(1, "en", 0, 2), (2, "de", 0, 1), (2, "en", 0, 1), (3, "en", 16, 1), (9, "en", 16, 1)]


def test_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.where("false"), labels).collect() == []


# -- alignment --------------------------------------------------------------


def aligned(everything):
    """By the definition, a document and a pair at a time."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    value = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    held, holders = [], collections.Counter()
    for doc, text in everything:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(value[c] for c in a_model.id_to_token(i)) for i in a]
        pieces = map(b_model.id_to_piece, b)
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        a_ends, b_ends = list(itertools.accumulate(map(len, a_bytes))), list(itertools.accumulate(map(len, b_bytes)))
        groups, before = [], 0
        for cut in sorted({*a_ends} & {*b_ends}):
            groups.append([[i for i, e in zip(ids, ends) if before < e <= cut] for ids, ends in ((a, a_ends), (b, b_ends))] if len(a) < 4000 else None)
            before = cut
        if len(a) >= 4000:  # the same, walking along
            groups, at, bt = [], iter(zip(a, a_ends)), iter(zip(b, b_ends))
            for cut in sorted({*a_ends} & {*b_ends}):
                groups.append([])
                for side in (at, bt):
                    ids = []
                    for i, e in side:
                        ids.append(i)
                        if e == cut:
                            break
                    groups[-1].append(ids)
        links = [pair for xs, ys in groups for pair in itertools.product(xs, ys)]
        holders.update(set(links))
        held.append((doc, a, b, groups, links))
    most = collections.Counter()
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    for doc, a, b, groups, links in held:
        text = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        yield (doc, len(a), len(b), len(groups), len(links), sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else "")


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.mark.parametrize("common", [1 << 20, 40, 0])
def test_alignment(docs, common):
    """Whether all, some or none of the pairs are common ones."""
    found = token_alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), common)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=repr)
    assert got == sorted(aligned([(d, t or "") for d, t, *_ in rows()]), key=repr)
    by = {r[0]: r for r in got}
    assert by[90][1:] == (0, 0, 0, 0, 0, 0, "") and by[94][1] == 0  # U+2581 in a text is a space to one side only


def test_alignment_of_nothing(spark, docs):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    assert token_alignment.align(docs.where("false"), *paths).collect() == []
    lone = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(r.n_links for r in token_alignment.align(lone, *paths).collect()) == [0, 0]


def test_wide_groups():
    """A group without common cuts inside: equal ids are counted, not paired."""
    a, b = np.array([1] * 300 + [2]), np.array([3] * 150 + [4])
    whole = token_alignment.Aligned(a, b, np.array([0, 3, 2]), np.array([0, 0, 0, 6, 2]))
    whole.a_group[:], whole.b_group[:] = 0, 0
    whole.n_a, whole.n_b = np.array([301]), np.array([151])
    doc, key, links = whole.pairs(np.array([0]), 10)
    assert list(zip(key.tolist(), links.tolist())) == [(13, 45000), (14, 300), (23, 150), (24, 1)]


# -- fingerprints -----------------------------------------------------------


def descending(everything):
    return sorted(everything, key=lambda r: (r[0] is None, -(r[0] or 0)))


@pytest.mark.parametrize("parts", [1, 9])
def test_edited_texts(spark, parts):
    """Every text but those that share a doc_id, whose order is that of a hash."""
    seen = collections.Counter(d for d, *_ in rows())
    some = [r for r in rows() if seen[r[0]] == 1]
    ordered = descending([(r[0], r[1] or "") for r in some])
    want = {}
    for (doc, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        want[doc] = (len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    got = edit_fingerprint.edited(spark.createDataFrame(some, SCHEMA).repartition(parts)).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    texts = dict(ordered)
    assert len({(texts[r.doc_id], r.fingerprint) for r in got}) == len({texts[r.doc_id] for r in got})
    long = [r for r in got if r.n_chars > 200 and r.doc_id not in range(100, 140) and r.doc_id not in (92, 93, 96, 98)]
    assert all(r.near_edited > r.near_next for r in long) and abs(np.mean([r.near_edited for r in long]) - 0.5) < 0.1
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


def test_repeated_rows_and_nulls_have_rows_each(docs):
    got = edit_fingerprint.edited(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows())
    assert edit_fingerprint.edited(docs.where("false")).collect() == []


def test_one_document_is_its_own_next(spark):
    (r,) = edit_fingerprint.edited(spark.createDataFrame([(1, "abcdefg")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest() and r.near_next == 1.0


def test_borders_tell_equal_ids_apart():
    ranges = edit_fingerprint.Ranges([(3, 10), (5, -4), (5, 7), (9, 0)])
    keys = [(2, 99), (3, 9), (3, 10), (5, -5), (5, -4), (5, 6), (5, 7), (9, -1), (9, 0), (10, 0)]
    o, h = (np.array(x) for x in zip(*keys))
    assert ranges.of(o, h).tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    ranges.firsts = {0: (2, 99), 3: (5, 7)}
    assert ranges.also(np.array([0, 3, 3]), np.array([2, 5, 9]), np.array([99, 7, -1])) == [[0, -4], [3, -1], [3]]


def test_likeness_follows_edits():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    walks = edit_fingerprint.Walks()
    for _ in range(20):
        text = " ".join(rnd.choice(words) for _ in range(400))
        versions, chars = [text], list(text)
        for _ in range(3):
            for _ in range(len(text) // 40):
                k = rnd.randrange(len(chars))
                chars[k : k + 1] = rnd.choice([[], ["z"], [chars[k], "q"]])
            versions.append("".join(chars))
        prints = walks.fingerprints([edit_fingerprint.points(t) for t in versions])
        likes = [float(edit_fingerprint.likeness(prints[:1], prints[k : k + 1])[0]) for k in range(4)]
        assert likes[0] == 1 and likes[0] > likes[1] > likes[3] - 0.05 and likes[1] > 0.4


def test_near_copies(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    base, found = say(400), []
    for i in range(30):
        changed = list(base)
        changed[rnd.randrange(400)] = f"odd{i}"
        found.append((100 + i, " ".join(changed)))
    found += [(i, " ".join(say(300))) for i in range(30)] + [(200, found[3][1]), (None, "x"), (300, None), (301, "")]
    got = {r.doc_id: r.class_id for r in edit_fingerprint.near_copies(spark.createDataFrame(found, "doc_id long, text string")).collect()}
    assert {got[100 + i] for i in range(30)} == {100} and got[200] == 100 and got[301] == 300
    assert all(got[i] == i for i in range(30)) and len(got) == 63
