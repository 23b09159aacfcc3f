"""Alignment of two lists of lines with the fewest lines removed and added, and its hunks as text.

The longest common subsequence by rows of bits: bit j of row i is clear where the first i lines have one more line in common with
the first j + 1 of the other side than with the first j. A row follows from the one before by one addition over the whole row, and the way
back through the rows is the alignment. Rows of more than ``MOST_BITS`` in all are halved first, at the place where both halves' counts are highest.
"""

from __future__ import annotations

MOST_BITS = 1 << 31


def _rows(a: list[str], b: list[str]):
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        held = row & places.get(line, 0)
        row = ((row + held) | (row - held)) & full
        yield row


def _counts(a: list[str], b: list[str]) -> list[int]:
    """Lines in common of all of ``a`` with each beginning of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    out = [0]
    for bit in reversed(bin((1 << len(b)) | row)[3:]):
        out.append(out[-1] + (bit == "0"))
    return out


def common(a: list[str], b: list[str], most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order; equal beginnings and ends belong to it."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    end = 0
    while end < min(len(a), len(b)) - low and a[-1 - end] == b[-1 - end]:
        end += 1
    head = [(k, k) for k in range(low)]
    tail = [(len(a) - end + k, len(b) - end + k) for k in range(end)]
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    inner: list[tuple[int, int]] = []
    if len(a) > 1 and len(a) * len(b) > most_bits:
        half = len(a) // 2
        above, below = _counts(a[:half], b), _counts(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: above[j] + below[j])
        inner = common(a[:half], b[:cut], most_bits) + [(i + half, j + cut) for i, j in common(a[half:], b[cut:], most_bits)]
    elif a and b:
        rows = list(_rows(a, b))
        i, j = len(a), len(b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                    inner.append((i, j))
        inner.reverse()
    return head + [(i + low, j + low) for i, j in inner] + tail


def lines(text: str | None) -> list[str]:
    """Lines as they end in newlines; the last one need not."""
    found = (text or "").split("\n")
    return found[:-1] if found[-1] == "" else found


def _range(begin: int, n: int) -> str:
    return str(begin + 1) if n == 1 else f"{begin + (n > 0)},{n}"


def hunks(old: str | None, new: str | None, context: int = 3, ignore_space: bool = False) -> str:
    """Unified hunks; '' where nothing differs. Lines that differ in white space alone may be taken for equal; the old ones are shown then."""
    a, b = lines(old), lines(new)
    key = (lambda x: "".join(x.split())) if ignore_space else (lambda x: x)
    pairs = [*common(list(map(key, a)), list(map(key, b))), (len(a), len(b))]
    changes, i, j = [], 0, 0  # (old from, to, new from, to)
    for x, y in pairs:
        if x > i or y > j:
            changes.append((i, x, j, y))
        i, j = x + 1, y + 1
    groups: list[list[tuple[int, int, int, int]]] = []
    for change in changes:
        if groups and change[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(change)
        else:
            groups.append([change])
    out = []
    for group in groups:
        (i, _, j, _), (_, x, _, y) = group[0], group[-1]
        begin, before = i - min(context, i), j - min(context, i)
        end = min(x + context, len(a))
        out.append(f"@@ -{_range(begin, end - begin)} +{_range(before, y + end - x - before)} @@")
        at = begin
        for i, x, j, y in group:
            out += [" " + line for line in a[at:i]] + ["-" + line for line in a[i:x]] + ["+" + line for line in b[j:y]]
            at = x
        out += [" " + line for line in a[at:end]]
    return "\n".join(out)
