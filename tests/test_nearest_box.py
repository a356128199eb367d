"""The nearest box on a page: outward search against all pairs, and a page of many thousands of blocks."""

import math
import random
import time

from pyspark.sql import functions as F

from tablewright.operators import review


def boxes(rng, n):
    out = []
    for _ in range(n):
        x, y = rng.choice([rng.random(), 0.5]), rng.choice([rng.random(), 0.25])
        out.append((x, y, x + rng.random() / 20, y + rng.random() / 50))
    return out


def test_outward_search_against_all_pairs():
    rng = random.Random(2)
    for aside in (1.0, 3.0):
        for _ in range(60):
            hits, anchors = boxes(rng, rng.randrange(1, 12)), boxes(rng, rng.randrange(0, 40))
            middle = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)

            def far(h, a, aside=aside):
                (x, y), (u, v) = middle(h), middle(a)
                return math.sqrt((x - u) ** 2 + (y - v) ** 2) * (aside if y < a[1] - 0.005 or x < a[0] - 0.005 else 1.0)

            want = [min((far(h, a) for a in anchors), default=None) for h in hits]
            assert review.nearest(hits, anchors, aside) == want


def test_a_page_of_many_hits_and_anchors(spark):
    rng = random.Random(3)
    rows = [(1, 1, n, *b, "Rate 4.25%" if n % 10 == 0 else "due date" if n % 10 == 1 else f"text {n}") for n, b in enumerate(boxes(rng, 50_000))]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, block int, x0 double, y0 double, x1 double, y1 double, text string")
    values = spark.createDataFrame([(1, 1, "rate", "4.25%", "due date"), (1, 1, "none", "9.75%", "due date"), (1, 1, "plain", "4.25%", None)], "doc_id long, page int, field string, value string, label string")
    began = time.time()
    got = {r.field: r.block for r in review.locate_values(values, blocks).collect()}
    figures = review.locate_figure(spark.createDataFrame([(1, "4.25%", "the due date of it")], "doc_id long, figure string, near string"), blocks).collect()
    assert time.time() - began < 60
    hits = [(r[2], r[3:7]) for r in rows if r[2] % 10 == 0]
    far = review.nearest([b for _, b in hits], [r[3:7] for r in rows if r[2] % 10 == 1], 3.0)
    assert got == {"rate": min(zip(far, [n for n, _ in hits], strict=True))[1], "plain": 0} and len(figures) == 20 and figures[0]["rank"] == 1
    assert review.locate_values(values, blocks.filter(F.lit(False))).count() == 0
