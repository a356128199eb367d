"""Operator 12, interaction audit of filters: what each filter removes in every order, from one pass over the rows.

Rows come down to counts by (part, mask of failed filters) before anything is compared. Per part, a walk through all
subsets of filters in Gray-code order toggles one filter at a time: each mask cell has a counter of its failures among
the filters that are on, and running totals of survivors change only by cells whose counter leaves or reaches zero. The
totals of every subset are kept (32 states for five filters), and a step of any order is the difference of two states.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import hot_keys, materialise, salted_join

#: White space of the contracts of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
#: More filters than this make more orders than a report can hold.
MOST_FILTERS = 7

COUNTS = ("docs", "good", "toxic")


def walk(masks: np.ndarray, counts: np.ndarray, n_filters: int) -> np.ndarray:
    """Survivors of every subset of filters, (2 ** n_filters, columns of counts); masks: failed filters of each cell, as bits."""
    states = np.zeros((1 << n_filters, counts.shape[1]), np.int64)
    active = np.zeros(len(masks), np.int64)
    running = counts.sum(axis=0)
    states[0] = running
    subset = 0
    for step in range(1, 1 << n_filters):
        bit = (step & -step).bit_length() - 1  # the filter that the Gray code toggles
        subset ^= 1 << bit
        failing = (masks >> bit & 1).astype(bool)
        if subset >> bit & 1:
            running = running - counts[failing & (active == 0)].sum(axis=0)
            active[failing] += 1
        else:
            active[failing] -= 1
            running = running + counts[failing & (active == 0)].sum(axis=0)
        states[subset] = running
    return states


def audit_cells(cells: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of cells (part, mask, docs, good, toxic).

    names: one letter for each filter, bit k of a mask is the k-th.
    """
    orders = list(permutations(range(len(names))))

    def report(part: pd.DataFrame) -> pd.DataFrame:
        masks, counts = part["mask"].to_numpy(np.int64), part[list(COUNTS)].to_numpy(np.int64)
        states = walk(masks, counts, len(names))
        failing = [int(counts[(masks >> k & 1) == 1, 0].sum()) for k in range(len(names))]
        unique = [int(counts[masks == 1 << k, 0].sum()) for k in range(len(names))]
        rows, total = [], [0] * len(names)
        for order in orders:
            subset = 0
            for step, k in enumerate(order, 1):
                lost = states[subset] - states[subset | 1 << k]
                subset |= 1 << k
                total[k] += int(lost[0])
                rows.append(("".join(names[j] for j in order), step, int(states[subset][0]), int(lost[0]), failing[k] - int(lost[0]), unique[k], int(lost[1]), int(lost[2]), k))
        out = pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "k"])
        out["shapley"] = out["k"].map(dict(enumerate(total)))
        out.insert(0, "part", part["part"].iloc[0])
        return out.drop(columns="k")

    kind = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return cells.groupBy("part").applyInPandas(report, kind)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that isn't null."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def filter_cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], copies: str | None) -> DataFrame:
    """(part, mask, docs, good, toxic): rows of docs by lang and failed filters. At most 2 ** filters rows for each lang.

    `filters`: conditions over docs' columns, each true, false or null (no failure). `copies`: letter of one more filter
    that a row fails whose text equals that of a smaller doc_id. Texts are compared by sha256 and never shuffled; texts
    and ids that many rows share are split. A null text is empty, a null lang the part "", and a row without doc_id has
    no label and is no copy. Of labels with several rows of an id, one row that says 1 is enough.
    """
    names = [*filters, *([copies] if copies else [])]
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters; all orders of at most {MOST_FILTERS} are reported")
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), digest.alias("digest"), mask.alias("mask"))
    rows = materialise(rows, "filter-rows")

    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    alike = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("docs"))
    alike = materialise(alike, "filter-ids")
    n_rows = alike.count()
    ids = hot_keys(alike.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "n", n_rows)
    known = salted_join(alike, flags, "doc_id", ids, ["digest", "part"], "left")
    known = known.select("doc_id", "part", "digest", "mask", "docs", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    unnamed = rows.filter("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("docs"))
    unnamed = unnamed.select("part", "mask", "docs", F.lit(0).alias("good"), F.lit(0).alias("toxic"))

    if copies:
        # equal texts have equal masks, so the rows of one text come down to one per (part, flags) before they meet
        groups = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
            F.sum("docs").alias("docs"), F.min("doc_id").alias("first"), F.min_by(F.struct("docs"), "doc_id").alias("at_first")
        )
        least = groups.groupBy("digest").agg(F.min("first").alias("least"), F.collect_list(F.struct("part", "mask", "good", "toxic", "docs", "first", "at_first")).alias("g"))
        each = least.select("least", F.explode("g").alias("g")).select("least", "g.*")
        own = F.when(F.col("first") == F.col("least"), F.col("at_first.docs")).otherwise(F.lit(0))
        split = F.array(F.struct(F.col("mask"), own.alias("docs")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("docs") - own).alias("docs")))
        known = each.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "s.mask", "s.docs", "good", "toxic")
    known = known.select("part", "mask", "docs", "good", "toxic").unionByName(unnamed).filter("docs > 0")
    return known.groupBy("part", "mask").agg(
        F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("good")).alias("good"), F.sum(F.col("docs") * F.col("toxic")).alias("toxic")
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of `audit_cells` for the five text filters A to E over docs; an empty table has no parts and so no rows."""
    text = F.coalesce("text", F.lit(""))
    return audit_cells(filter_cells(docs, labels, text_filters(text), copies="E"), "ABCDE")


ORACLE_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN words.doc_id > first THEN 16 ELSE 0 END AS mask
  FROM words LEFT JOIN flags USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || d.c || e.c || f.c AS o FROM letters a, letters b, letters d, letters e, letters f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (SELECT o, s, (1 << (ascii(o[s]) - 65)) AS own, list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
counted AS (SELECT part, o AS filter_order, s AS step, own,
    sum(CASE WHEN mask & (own | coalesce(before, 0)::BIGINT) = 0 THEN docs ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN docs ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::BIGINT <> 0 THEN docs ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, o, s, own, before)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
