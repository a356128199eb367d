"""The weighted likeness of labels: written values, plain loops, and a search that passes over no name wrongly."""

import random

import pytest

from tablewright.functions import likeness as m
from tablewright.operators import mapping


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_window(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    pieces = [b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))]
    best = max(plain_ratio(a, p) for p in pieces)
    if len(a) == len(b):
        best = max(best, *[plain_ratio(b, a[max(0, i) : i + len(b)]) for i in range(1 - len(b), len(a))])
    return best


def plain(a, b):
    if not a or not b:
        return 0.0
    wa, wb = a.split(), b.split()
    both, oa, ob = sorted(set(wa) & set(wb)), sorted(set(wa) - set(wb)), sorted(set(wb) - set(wa))
    sa, sb = " ".join(sorted(wa)), " ".join(sorted(wb))
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        views = [plain_ratio(sa, sb)]
        if both and (not oa or not ob):
            views.append(100.0)
        elif wa and wb:
            s, ta, tb = " ".join(both), " ".join(both + oa), " ".join(both + ob)
            a_, b_ = " ".join(oa), " ".join(ob)
            views.append(100 - 100 * (len(a_) + len(b_) - 2 * lcs(a_, b_)) / (len(ta) + len(tb)))
            if s:
                views += [plain_ratio(s, ta), plain_ratio(s, tb)]
        else:
            views = [0.0]
        return max(plain_ratio(a, b), 0.95 * max(views))
    part = 0.9 if longer <= 8 else 0.6
    if not wa or not wb:
        views = 0.0
    elif both:
        views = 100.0
    else:
        views = max(plain_window(sa, sb), plain_window(" ".join(oa), " ".join(ob)))
    return max(plain_ratio(a, b), part * plain_window(a, b), 0.95 * part * views)


#: Written down from the definition.
VALUES = [
    ("Nett Incomes", "Net Income", 90.9091), ("Utilitys", "Utilities", 82.3529), ("Total Utilities Expense", "Utilities", 90.0), ("Rent", "Rent", 100.0), ("", "Rent", 0.0),
    ("Rental income", "income Rental", 95.0), ("Rent income", "Rent income monthly", 90.0), ("Rent inc.", "Rent income", 80.0), ("abcd", "wxyz", 0.0), ("Water", "Waste", 80.0),
    ("A", "ABCDEFGH", 90.0), ("A", "ABCDEFGHI", 60.0), ("Tax Tax", "Tax", 90.0), ("Late fee", "Late fees", 94.1176),
]


@pytest.mark.parametrize(("a", "b", "score"), VALUES)
def test_written_values(a, b, score):
    assert round(m.likeness(a, b), 4) == round(m.likeness(b, a), 4) == score


def some_labels(seed, n):
    rng = random.Random(seed)
    words = ["rent", "Rent", "income", "incomes", "total", "tax", "taxes", "water", "waste", "a", "of", "utility", "utilities", "ünder", "fee"]

    def label():
        t = " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 2, 3, 6])))
        for _ in range(rng.choice([0, 0, 1, 2])):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["x", "", " ", "e"]) + t[i + rng.randrange(2) :]
        return " ".join(t.split()) or "q"

    return [label() for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_loops(seed):
    for a, b in zip(some_labels(seed, 150), some_labels(seed + 50, 150), strict=True):
        assert abs(m.likeness(a, b) - plain(a, b)) < 1e-9, (a, b)


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold_and_the_best_are_found(seed):
    names = sorted(set(some_labels(seed, 120)))
    index = m.NameIndex(names)
    for label in some_labels(seed + 90, 40):
        scores = [m.likeness(label, n) for n in names]
        assert (index.bounds(label) >= scores).all()
        want = sorted(range(len(names)), key=lambda i: (-scores[i], i))[:3]
        assert index.best(label, 3) == [(names[i], scores[i]) for i in want]
    assert m.NameIndex([]).best("x", 2) == []


def test_names_in_several_passes_and_odd_tables(spark, monkeypatch):
    rows = spark.createDataFrame([("Utilitys",), ("Total Utilities Expense",), ("  ",), (None,), ("Utilities",), ("Utilities",)], "label string")
    names = spark.createDataFrame([(n,) for n in ["Utilities", "Gas cost", "Rent", "Water", "Taxes", "Fees", "", None]], "canonical string")
    memory = spark.createDataFrame([], "norm_label string, canonical string, seq long")
    key = lambda r: r.label
    whole = sorted(mapping.match_labels(rows, names, memory).collect(), key=key)
    assert {r.label: (r.canonical, r.tier, r.confidence) for r in whole} == {
        "Utilitys": ("Utilities", "weak", 82.3529), "Total Utilities Expense": ("Utilities", "fuzzy", 90.0), "Utilities": ("Utilities", "exact", 100.0), "  ": (None, "empty", 0.0),
    }
    top = mapping.label_candidates(rows, names, 2).collect()
    monkeypatch.setattr(mapping, "NAMES_A_PASS", 2)
    assert sorted(mapping.match_labels(rows, names, memory).collect(), key=key) == whole
    assert sorted(mapping.label_candidates(rows, names, 2).collect()) == sorted(top) and len(top) == 6
    got = mapping.match_labels(rows, names.filter("false"), memory).collect()
    assert {r.tier for r in got} == {"none", "empty"}
