"""How alike two labels are, from 0 to 100, and the names most alike to a label.

The measure weighs four views of two texts: their longest common subsequence; the same of their sorted words; of what
their word sets share and don't share; and, where one text is much longer, of the shorter against the best window of the
longer. A search for the best names bounds the measure of all names by the letters that two texts share, in one vector
operation, and computes it only for names whose bound reaches what has been found. No name is passed over wrongly.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

# Weights of the views, and the ratios of lengths where they change.
WORDS, PART, SMALL_PART = 0.95, 0.9, 0.6
MUCH_LONGER, FAR_LONGER = 1.5, 8.0


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one step of a bit vector for each letter of b."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def best_window(a: str, b: str) -> float:
    """Ratio of the shorter text and the stretch of the longer, of its length or cut off at an end, that is most like it."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0 if long else 100.0
    if short in long:
        return 100.0
    letters, best = set(short), 0.0
    for start in range(1 - len(short), len(long)):
        piece = long[max(0, start) : start + len(short)]
        if (piece[-1] if start + len(short) <= len(long) else piece[0]) in letters:
            best = max(best, ratio(short, piece))
    if len(short) == len(long) and best < 100:
        letters = set(long)
        for start in range(1 - len(long), len(short)):
            piece = short[max(0, start) : start + len(long)]
            best = max(best, ratio(long, piece))
    return best


def word_views(a: str, b: str, window: bool) -> float:
    """The better of sorted words and word sets, or, with `window`, of their best windows."""
    in_a, in_b = a.split(), b.split()
    both, only_a, only_b = set(in_a) & set(in_b), sorted(set(in_a) - set(in_b)), sorted(set(in_b) - set(in_a))
    if not in_a or not in_b:
        return 0.0
    if both and (window or not only_a or not only_b):
        return 100.0
    sorted_a, sorted_b, rest_a, rest_b = " ".join(sorted(in_a)), " ".join(sorted(in_b)), " ".join(only_a), " ".join(only_b)
    if window:
        whole = best_window(sorted_a, sorted_b)
        return whole if len(only_a) == len(in_a) and len(only_b) == len(in_b) else max(whole, best_window(rest_a, rest_b))
    shared = len(" ".join(both))
    gap = 1 if shared else 0
    with_a, with_b = shared + gap + len(rest_a), shared + gap + len(rest_b)
    apart = len(rest_a) + len(rest_b) - 2 * common(rest_a, rest_b)
    sets = [100 - 100 * apart / (with_a + with_b)]
    if shared:
        sets += [100 - 100 * (gap + len(rest)) / (shared + own) for rest, own in ((rest_a, with_a), (rest_b, with_b))]
    return max(ratio(sorted_a, sorted_b), *sets)


def likeness(a: str, b: str) -> float:
    """0 to 100; 0 if one is empty."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < MUCH_LONGER:
        return max(ratio(a, b), WORDS * word_views(a, b, window=False))
    part = PART if longer <= FAR_LONGER else SMALL_PART
    return max(ratio(a, b), part * best_window(a, b), WORDS * part * word_views(a, b, window=True))


class NameIndex:
    """Names in the order that decides ties, with their letter counts and the places of each word."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)
        letters = sorted({c for n in self.names for c in n})
        self.letters = {c: k for k, c in enumerate(letters)}
        self.counts = np.zeros((len(letters), len(self.names)), np.int32)  # a row for each letter: a label reads its own letters only
        places: dict[str, list[int]] = {}
        for i, name in enumerate(self.names):
            for c in name:
                self.counts[self.letters[c], i] += 1
            for word in set(name.split()):
                places.setdefault(word, []).append(i)
        self.places = {w: np.array(p) for w, p in places.items()}
        self.lengths = np.array([len(n) for n in self.names], float)
        self.distinct = np.array([len(" ".join(sorted(set(n.split())))) for n in self.names], float)

    def bounds(self, label: str) -> np.ndarray:
        """At least the likeness of the label and each name."""
        own: dict[str, int] = {}
        for c in label:
            own[c] = own.get(c, 0) + 1
        shared = np.zeros(len(self.names))
        for c, n in own.items():
            if c in self.letters:
                shared += np.minimum(self.counts[self.letters[c]], n)
        with_word = np.zeros(len(self.names), bool)
        for word in set(label.split()):
            if word in self.places:
                with_word[self.places[word]] = True
        size, distinct = float(len(label)), float(len(" ".join(sorted(set(label.split())))))
        whole = 200 * shared / np.maximum(1, size + self.lengths)
        words = np.where(with_word, 100, np.minimum(100, 200 * shared / np.maximum(1, distinct + self.distinct)))
        window = np.minimum(100, 200 * shared / np.maximum(1, np.minimum(size, self.lengths) + shared))
        word_window = np.where(with_word, 100, np.minimum(100, 200 * shared / np.maximum(1, np.minimum(distinct, self.distinct) + shared)))
        longer = np.maximum(size, self.lengths) / np.maximum(1, np.minimum(size, self.lengths))
        part = np.where(longer <= FAR_LONGER, PART, SMALL_PART)
        far = np.maximum(whole, np.maximum(part * window, WORDS * part * word_window))
        return np.where(longer < MUCH_LONGER, np.maximum(whole, WORDS * words), far) + 1e-6

    def best(self, label: str, k: int = 1) -> list[tuple[str, float]]:
        """The k names most alike, best first, ties in the order of names."""
        bounds = self.bounds(label)
        found: list[tuple[float, int]] = []  # a heap of (score, -place): its first is the one to beat
        for i in np.argsort(-bounds, kind="stable").tolist():
            if len(found) == k and bounds[i] < found[0][0]:
                break
            entry = (likeness(label, self.names[i]), -i)
            if len(found) < k:
                heapq.heappush(found, entry)
            else:
                heapq.heappushpop(found, entry)
        return [(self.names[-i], score) for score, i in sorted(found, reverse=True)]
