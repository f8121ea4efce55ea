"""Plain sequential versions of the similarity operators for comparison."""

import re

from tallysmith.functions.text import STOP_WORDS


def tokens(text):
    return sorted({w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP_WORDS})


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    if not a or not b:
        return 0.0
    common = " ".join(x for x in a if x in b)
    left, right = " ".join(x for x in a if x not in b), " ".join(x for x in b if x not in a)
    if common and not (left and right):
        return 100.0
    gap = 1 if common else 0
    size_a, size_b = len(common) + gap + len(left), len(common) + gap + len(right)
    scores = [100 - 100 * (len(left) + len(right) - 2 * lcs(left, right)) / (size_a + size_b)]
    if common:
        scores += [100 - 100 * (gap + len(d)) / (len(common) * 2 + gap + len(d)) for d in (left, right)]
    return max(scores)


def dedupe(rows, threshold):
    kept, marks = {}, {}
    for position, area, text in sorted(rows):
        words = tokens(text)
        seen = kept.setdefault(area, [])
        marks[position] = 0 if words and any(ratio(words, k) >= threshold for k in seen) else 1
        if marks[position]:
            seen.append(words)
    return marks


def accept(rows, need, threshold, existing=()):
    """rows: (position, area, standard, type, text); need: slot -> number."""
    kept = {}
    for area, text in existing:
        kept.setdefault(area, []).append(tokens(text))
    left, marks = dict(need), {}
    for position, area, standard, kind, text in sorted(rows):
        slot = (area, standard, kind)
        words = tokens(text)
        if left.get(slot, 0) <= 0:
            marks[position] = "slot_full"
        elif any(ratio(words, k) >= threshold for k in kept.setdefault(area, [])):
            marks[position] = "duplicate"
        else:
            marks[position] = "accepted"
            kept[area].append(words)
            left[slot] -= 1
    return marks
