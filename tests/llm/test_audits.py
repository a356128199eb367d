"""Manifest, filter audit and url filters against plain loops, and the odd cases of each."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import filter_audit, merkle, url_filters
from tests.llm.test_operators import ODD, documents

# op11


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, at, fan_out):
    """Root of a list of digests and the siblings of the one at a place, level by level."""
    siblings = []
    while len(nodes) > 1:
        start = at // fan_out * fan_out
        run = nodes[start : start + fan_out]
        siblings += run[: at - start] + run[at - start + 1 :]
        nodes, at = [sha("".join(nodes[i : i + fan_out])) for i in range(0, len(nodes), fan_out)], at // fan_out
    return nodes[0], siblings


def plain_manifest(rows, changed, fan_out):
    by_lang = {}
    for i, r in enumerate(rows):
        by_lang.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), plain_leaf(r, r["text"]), i))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: [leaf for _, leaf, _ in sorted(by_lang[x])] for x in langs}
    subroots = [plain_tree(trees[x], 0, fan_out)[0] for x in langs]
    out = []
    for k, x in enumerate(langs):
        for at, (_, leaf, i) in enumerate(sorted(by_lang[x])):
            subroot, below = plain_tree(trees[x], at, fan_out)
            root, above = plain_tree(subroots, k, fan_out)
            new = plain_leaf(rows[i], changed(rows[i]))
            folded, _ = plain_tree(trees[x][:at] + [new] + trees[x][at + 1 :], at, fan_out)
            folded, _ = plain_tree(subroots[:k] + [folded] + subroots[k + 1 :], k, fan_out)
            out.append((rows[i]["doc_id"], leaf, subroot, root, sha("".join(below + above)), folded, folded == root))
    return out


@pytest.mark.parametrize(("n", "langs", "fan_out", "levels"), [(90, 3, 2, 2), (90, 11, 3, 1), (130, 2, 8, 3), (20, 20, 2, 2), (1, 1, 8, 3)])
def test_manifest_against_plain_loops(spark, n, langs, fan_out, levels):
    rng = np.random.RandomState(n)
    names = [None, *[f"l{i}é" for i in range(langs - 1)]]
    rows = [(int(i), None if i % 13 == 5 else f"Text {'x' * int(rng.randint(9))} {i}", names[rng.randint(langs)], "s") for i in range(n)]
    docs = documents(spark, rows)
    changed = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    got = merkle.merkle_manifest(docs, changed, fan_out, levels).drop("lang").collect()
    want = plain_manifest([r.asDict() for r in docs.collect()], lambda r: r["text"].lower() if r["text"] and r["doc_id"] % 3 == 0 else r["text"], fan_out)
    assert sorted(map(tuple, got)) == sorted(want) and {r.verified for r in got} == ({True, False} if n > 1 else {False})


def test_manifest_of_odd_tables(spark):
    docs = documents(spark, ODD).withColumns({"leaf": F.lit("x"), "key": F.lit(1), "pos": F.lit(2)})
    got = merkle.merkle_manifest(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert len(got) == len(ODD) and all(r.verified for r in got) and len({r.root for r in got}) == 1
    assert sorted(map(key, got)) == sorted(map(key, merkle.merkle_manifest(docs.repartition(7)).collect()))
    assert merkle.merkle_manifest(documents(spark, [])).count() == 0
    same = merkle.merkle_manifest(documents(spark, [(1, "a", "en", "s")] * 20 + [(None, "b", "en", "s")] * 3)).collect()
    assert len(same) == 23 and len({r.leaf for r in same}) == 2


def test_states_before_a_slot_give_what_a_whole_hash_gives():
    children = [sha(str(i)).encode() for i in range(8)]
    parent = merkle.Parent(children)
    for slot in range(8):
        changed = [*children[:slot], b"0" * 64, *children[slot + 1 :]]
        assert parent.fold(slot, b"0" * 64).decode() == hashlib.sha256(b"".join(changed)).hexdigest()


# op12


def plain_audit(rows, labels):
    first = {}
    for d, text, *_ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    parts = {}
    for d, text, lang, *_ in rows:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > first[t],
        }
        good, toxic = (any(q == 1 for i, q, _ in labels if i == d and d is not None), any(x == 1 for i, _, x in labels if i == d and d is not None))
        parts.setdefault(lang or "", []).append((fails, good, toxic))
    out = []
    for part, docs in parts.items():
        total, lines = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left_now = [x for x in left if x[0][f]], [x for x in left if not x[0][f]]
                total[f] += len(gone)
                failing = sum(x[0][f] for x in docs)
                only = sum(x[0][f] and sum(x[0].values()) == 1 for x in docs)
                lines.append((part, "".join(order), step, len(left_now), len(gone), failing - len(gone), only, sum(x[1] for x in gone), sum(x[2] for x in gone), f))
                left = left_now
        out += [(*x[:-1], total[x[-1]]) for x in lines]
    return out


def test_audit_against_plain_loops(spark):
    rng = np.random.RandomState(4)
    texts = [None, "", " \t", "A b", "a $ b", "w " * 120, " ".join(f"w{i}" for i in range(130)), " ".join(f"W{i}" for i in range(130)), "é" * 50, "a\u00a0b | c"]
    rows = [(int(i) if i % 11 else None, texts[rng.randint(len(texts))], ["en", "de", None, ""][rng.randint(4)], "s") for i in range(150)]
    rows += [rows[7]] * 60 + [(9, None, "en", "s")] * 2
    labels = [(int(i), [0, 1, None][rng.randint(3)], [0, 1][rng.randint(2)]) for i in rng.randint(0, 150, 80)] + [(None, 1, 1), (10**6, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    docs = documents(spark, rows).withColumns({"mask": F.lit("x"), "docs": F.lit(1), "part": F.lit("y")})
    got = filter_audit.audit_filters(docs, frame).collect()
    assert sorted(map(tuple, got)) == sorted(plain_audit(rows, labels))


def test_audit_of_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(documents(spark, []), none).count() == 0
    got = filter_audit.audit_filters(documents(spark, [(1, " ".join(f"w{i}" for i in range(200000)), "en", "s")]), none).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [r.kept for r in got] == [1] * 5
    with pytest.raises(ValueError, match="filters"):
        filter_audit.filter_cells(documents(spark, []), none, {c: F.lit(True) for c in "ABCDEFGH"}, None)


@pytest.mark.parametrize("n", [1, 3, 6])
def test_walk_against_every_subset(n):
    rng = np.random.RandomState(n)
    masks, counts = np.arange(1 << n), rng.randint(0, 9, (1 << n, 3))
    states = filter_audit.walk(masks, counts, n)
    assert all((states[s] == counts[(masks & s) == 0].sum(axis=0)).all() for s in range(1 << n))


# op13


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    best = max(fit)[2]
    return host, path, best, "block" if any(v == "block" and k == best for *_, k, v in fit) else "allow"


URLS = [
    "https://www.Example.com/en/1?x=/es/", "http://example.com/en/", "http://example.com", "http://example.com?en/", "x://net/es/a", "HTTP://A.net/fr/#t", "http://a.net/de/", None, "", "no scheme/en/",
    "ftp://b.www.example.com/en/z#/fr/", "http://notexample.com/en/q", "http://example.com:80/en/", "http://ÉXAMPLE.com/en/", "a://b://c.com/x", "http://.com/", "http:///en/", "http://example.com./en/", "http://x.org/\n/en/",
]


def test_urls_against_plain_loops(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages).collect()}
    assert got == {i: plain_verdict(u, url_filters.RULES) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("parts", [1, 3])
def test_many_rules_are_exact_in_any_number_of_cascades(spark, parts):
    rng = np.random.RandomState(3)
    hosts = [f"{a}.{b}" for a in ("a", "bb", "ccc", "d.e") for b in ("com", "net", "org")] + ["com", "net"]
    paths = ["/", "/en/", "/e", "/news/x/", ""]
    rules = [(["allow", "block"][rng.randint(2)], hosts[rng.randint(len(hosts))], paths[rng.randint(5)]) for _ in range(40)]
    urls = [f"http://{'w.' * rng.randint(3)}{hosts[rng.randint(len(hosts))]}{['/', '/en/1', '/english', '/news/x/y', '', '/z'][rng.randint(6)]}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    keys = len({h + p for _, h, p in rules})
    out = url_filters.judge_urls(pages, rules, keys_a_cascade=-(-keys // parts), first_bits=2, later_bits=1)  # so few bits that every level errs
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}


def test_cascade_tells_listed_keys_from_all_others(spark):
    universe = spark.createDataFrame([(f"k{i}", i % 7 == 0) for i in range(3000)], "key string, listed boolean")
    cascade = url_filters.build_cascade(universe, first_bits=3, later_bits=2)
    assert len(cascade.levels) > 2
    assert universe.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_urls_of_empty_tables_and_lists(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge_urls(pages).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in url_filters.judge_urls(some, spark.createDataFrame([], "verdict string, host string, path string"), default="block").collect()] == ["block"] * 3
    assert sorted(r.rule or "" for r in url_filters.judge_urls(some).collect()) == ["", "com/", "com/"]
    clash = [("block", "com", "/"), ("allow", "com", "/")]
    assert {r.verdict for r in url_filters.judge_urls(some.filter("url IS NOT NULL"), clash).collect()} == {"block"}
