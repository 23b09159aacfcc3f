"""Line alignments against the length of the longest common subsequence, and hunks that turn the old text into the new."""

import random
import time

import pytest

from datastrata.functions.alignment import common, hunks, lines


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
    return row[-1]


@pytest.mark.parametrize("most_bits", [1 << 31, 50, 1])
def test_longest_common_subsequences(most_bits):
    rnd = random.Random(most_bits)
    for _ in range(300):
        letters = "abcdefgh"[: rnd.randint(1, 8)]
        a, b = ([rnd.choice(letters) for _ in range(rnd.randint(0, 25))] for _ in range(2))
        found = common(a, b, most_bits)
        assert all(a[i] == b[j] for i, j in found) and len(found) == longest(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def applied(old, diff):
    """The new lines, by the old ones and the hunks; every range and context line is checked."""
    out, at, rest = [], 0, diff.split("\n") if diff else []
    heads = [k for k, line in enumerate(rest) if line.startswith("@@")]
    for k, end in zip(heads, [*heads[1:], len(rest)]):
        sides = [tuple(map(int, (s[1:] + ",1").split(",")[:2])) for s in rest[k].split()[1:3]]
        (begin, n), (after, m) = sides
        begin -= n > 0
        out += old[at:begin]
        at = begin
        assert len(out) == after - (m > 0)
        size = len(out)
        for line in rest[k + 1 : end]:
            if line[0] in " -":
                assert old[at] == line[1:]
                at += 1
            if line[0] in " +":
                out.append(line[1:])
        assert at - begin == n and len(out) - size == m
    return out + old[at:]


@pytest.mark.parametrize("context", [0, 1, 3])
def test_hunks_make_the_new_text(context):
    rnd = random.Random(context)
    for _ in range(200):
        a = [rnd.choice(["x", "y", "", "long line", f"n{rnd.randrange(9)}"]) for _ in range(rnd.randint(0, 40))]
        b = list(a)
        for _ in range(rnd.randint(0, 5)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 2)] = [f"new{rnd.randrange(3)}"] * rnd.randint(0, 2)
        old, new = ("".join(f"{x}\n" for x in s) for s in (a, b))
        diff = hunks(old, new, context)
        assert applied(a, diff) == b and (diff == "") == (a == b)
        changed = [x for x in diff.split("\n") if x[:1] in ("+", "-")]
        assert len(changed) == len(a) + len(b) - 2 * longest(a, b)


def test_white_space_and_nulls():
    assert hunks("a b\nc", "ab \nd", ignore_space=True) == "@@ -1,2 +1,2 @@\n a b\n-c\n+d"
    assert hunks(None, "") == "" and hunks(None, "x") == "@@ -0,0 +1 @@\n+x" and hunks("x\n", None) == "@@ -1 +0,0 @@\n-x"
    assert lines("a\n\n") == ["a", ""] and lines("") == []


def test_long_texts_of_few_kinds_of_lines():
    rnd = random.Random(2)
    a, b = ([rnd.choice(["", "}", "x", "y"]) for _ in range(8_000)] for _ in range(2))
    began = time.time()
    assert len(common(a, b)) > 4_000 and time.time() - began < 30
