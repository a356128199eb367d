"""Grouped prefix join: documents whose shingle sets have a Jaccard similarity above a threshold, exactly."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import discard, materialise, small_batches
from tablewright.llm.textvec import chunks, shingle_sets, trim

#: Counters of a task's sketch of shingle frequencies, as a power of two, and the most frequent that are kept of all.
#: They only order shingles, rare ones first; any order gives the same links.
SKETCH_BITS, HOT = 20, 1 << 16
#: Bits of a set's parity map: each element flips one, so two maps differ in no more bits than the sets do in elements.
PARITY_BITS = 512
#: Sets larger than this have a finer map too, as the first tells little of them.
LARGE, FINE_BITS = 1000, 4096


def hot_counters(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """For each counter of the sketch 0, or a rank that grows with its frequency, for the HOT most frequent ones.

    Every task counts all shingles of its documents and reports the counters that stand out; Spark sums these.
    """

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for pdf in batches:
            for _, part in chunks(pdf.t.tolist()):
                sets = shingle_sets(part, width)
                if sets:
                    places = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    total += np.bincount(places, minlength=1 << SKETCH_BITS)
        mean = total.mean()
        out = np.flatnonzero(total > mean + 6 * np.sqrt(mean) + 6)
        yield pd.DataFrame({"place": out.astype(np.int32), "more": total[out] - int(mean)})
        del total
        trim()

    seen = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "place int, more long")
    top = seen.groupBy("place").agg(F.sum("more").alias("more")).orderBy(F.desc("more"), "place").limit(HOT).collect()
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    for rank, row in enumerate(reversed(top), 1):
        out[row.place] = rank
    return out


def parity_map(s: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount(((s >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_table(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """doc_id, n (size of the set), node (its digest), grp (digest of prefix and size), prefix (hashes, rare first), bits
    (parity map), fine (a finer one of large sets, else empty)."""
    hot = hot_counters(docs, text_col, width)

    def prepare(batches):
        for pdf in batches:
            n, node, grp, prefix, bits, fine = [], [], [], [], [], []
            for _, part in chunks(pdf.t.tolist()):
                for s in shingle_sets(part, width):
                    rank = hot[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    ordered = s[np.lexsort((s, rank))] if rank.any() else s
                    p = ordered[: len(s) - -(-percent * len(s) // 100) + 1] if len(s) else s
                    n.append(len(s))
                    node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    grp.append(hashlib.blake2b(p.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).digest())
                    prefix.append(p.view(np.int64))
                    bits.append(parity_map(s, PARITY_BITS))
                    fine.append(parity_map(s, FINE_BITS) if len(s) > LARGE else bits[-1][:0])
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "n": n, "node": node, "grp": grp, "prefix": prefix, "bits": bits, "fine": fine})
        trim()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return own.mapInPandas(prepare, "doc_id long, n long, node binary, grp binary, prefix array<long>, bits array<long>, fine array<long>")


def may_reach(percent: int, na: str = "na", nb: str = "nb", ia: str = "ia", ib: str = "ib"):
    """Sizes that allow the similarity, and enough elements left from the first common one (at ia and ib) on."""
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    needed = F.ceil((F.col(na) + F.col(nb)) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))
    return sizes & (F.least(F.col(na) - F.col(ia), F.col(nb) - F.col(ib)) >= needed)


def maps_agree(percent: int, a: str = "ba", b: str = "bb"):
    """The parity maps a and b differ in no more bits than sets of sizes na and nb that reach the similarity may."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets, made again from the whole texts, reach the similarity."""

    def compare(batches):
        for pdf in batches:
            once: dict[str, np.ndarray] = {}
            todo = list(dict.fromkeys([*pdf.ta, *pdf.tb]))
            for first, part in chunks(todo):
                once.update(zip(todo[first : first + len(part)], shingle_sets(part, width), strict=True))
            linked = []
            for ta, tb in zip(pdf.ta, pdf.tb, strict=True):
                x, y = once[ta], once[tb]
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[linked, ["a", "b"]]
        trim()

    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(needed, "id")
    ta, tb = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that the edges (a, b) reach. Rounds go on until no label changes, however many it takes.

    In a round the least label next to a node goes to the node and to its label's own node, so that two regions that
    touch merge at once instead of hop by hop; then labels jump to their label's label.
    """
    both = materialise(edges.union(edges.select("b", "a")).distinct(), "edges")
    nearest = both.groupBy("a").agg(F.min("b").alias("m"))
    labels = materialise(nearest.select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.a == labels.id).groupBy(F.col("b").alias("id")).agg(F.min("label").alias("m"))
        near = labels.join(near, "id")
        least = near.select("id", "m").union(near.select("label", "m")).groupBy("id").agg(F.min("m").alias("m"))
        spread = labels.join(least, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        spread = materialise(spread, "spread")
        up = spread.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = spread.join(up, "label", "left").select("id", F.least("label", "up").alias("label"), "old")
        new = materialise(new, "labels")
        discard(labels, spread)
        labels = new.select("id", "label")
        if new.filter("label <> old").isEmpty():
            break
    discard(both)
    return labels.select("id", F.col("label").alias("component"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    A document's set holds the distinct shingles of `width` words, lower-cased in A-Z; a shorter text is one shingle of
    all its words. Two documents link when 100 * common >= percent * all of their sets. component_id is the least
    doc_id that links reach. No link between different sets is lost: documents of one set are one node; nodes with the
    same prefix and size are one group; groups that share a prefix shingle are candidates if
    sizes, places and parity maps allow the similarity. First each list of groups
    with a common shingle is compared with its best connected member alone; then, exactly, all pairs of the list that
    aren't in one component yet. So thousands of near copies cost a star and not all their pairs.

    A null or blank text has an empty set and links with nothing. Rows with a null id link with nothing and have a null
    component. Repeated rows share their set's node. Ties go to the least id. An empty table gives no rows. Other
    columns of docs are not read.
    """
    small_batches(docs)
    prep = materialise(prefix_table(docs, id_col, text_col, width, percent), "prefixes")
    gid = F.xxhash64("grp").alias("gid")
    nodes = materialise(prep.filter("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("grp").alias("grp"), F.first("bits").alias("bits"), F.first("fine").alias("fine")).select("node", "id", "n", gid, "bits", "fine"), "nodes")
    groups = prep.filter("n > 0 AND doc_id IS NOT NULL").groupBy("grp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    posts = groups.select(gid, "n", F.posexplode("prefix").alias("i", "token"))
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("lists")).filter("lists > 1")
    posts = materialise(posts.join(shared, "token"), "postings")

    degree = posts.groupBy("gid").agg(F.count(F.lit(1)).alias("degree"))
    best = posts.join(degree, "gid").groupBy("token").agg(F.max(F.struct("degree", "gid", "n", "i")).alias("p"))
    stars = (
        posts.join(best, "token")
        .select(F.col("p.gid").alias("ga"), F.col("gid").alias("gb"), F.col("p.n").alias("na"), F.col("n").alias("nb"), F.col("p.i").alias("ia"), F.col("i").alias("ib"))
        .filter((F.col("ga") != F.col("gb")) & may_reach(percent))
        .select("ga", "gb")
        .distinct()
    )
    leads = nodes.groupBy("gid").agg(F.min("id").alias("lead"))
    of = lambda side: leads.select(F.col("gid").alias(f"g{side}"), F.col("lead").alias(side))
    pairs = stars.join(of("a"), "ga").join(of("b"), "gb").select("a", "b")
    inside = nodes.join(leads, "gid").filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    maps = lambda s: nodes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"b{s}"), F.col("fine").alias(f"f{s}"))
    both_fine = (F.size("fa") > 0) & (F.size("fb") > 0)
    close = maps_agree(percent) & (~both_fine | maps_agree(percent, "fa", "fb"))
    likely = lambda p: p.join(maps("a"), "a").join(maps("b"), "b").filter(close).select("a", "b")
    tested = materialise(likely(ordered(pairs.union(inside))), "star-pairs")
    edges = materialise(verified(tested, docs, id_col, text_col, width, percent), "star-edges")
    found = components(edges)

    members = nodes.join(found, "id", "left").select("gid", "id", "n", "bits", F.coalesce("component", "id").alias("c"))
    several = nodes.groupBy("gid").count().filter("count > 1").select("gid")
    two = posts.filter("lists = 2")  # the star has compared all of these, but for groups of several nodes
    two = two.join(two.join(several, "gid", "left_semi").select("token").distinct(), "token", "left_semi")
    lists = posts.filter("lists > 2").union(two).select("token", "gid", "i")
    lists = lists.union(several.select(F.col("gid").alias("token"), "gid", F.lit(0).alias("i")))
    lists = lists.join(members, "gid")
    mixed = lists.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("token")
    lists = materialise(lists.join(mixed, "token").select("token", "id", "n", "i", "bits", "c"), "open-lists")
    rest = (
        lists.toDF("token", "a", "na", "ia", "ba", "ca")
        .join(lists.toDF("token", "b", "nb", "ib", "bb", "cb"), "token")
        .filter((F.col("ca") < F.col("cb")) & may_reach(percent) & maps_agree(percent))
        .select("a", "b")
    )
    rest = materialise(likely(ordered(rest).join(tested, ["a", "b"], "left_anti")), "rest-pairs")
    discard(posts, lists, tested)
    if not rest.isEmpty():
        more = verified(rest, docs, id_col, text_col, width, percent)
        first, found = found, components(edges.union(more))
        discard(first)
    discard(edges, rest)
    own = nodes.join(found, "id", "left").select("node", F.coalesce("component", "id").alias("component"))
    return prep.select("doc_id", "n", "node").join(own, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )
