import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup, html_extract, language_id, line_dedup, mixing, nearest, ngram_jaccard, packing, quality, sharding, stages
from tablewright.llm.textvec import shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with a column that clashes with names used inside the operators."""
    return spark.createDataFrame([(*r, None, "x") for r in rows], DOCS)


ODD = [(1, None, "en", "a"), (2, "", None, None), (3, "  \n", "en", "a"), (4, "one two three four", "en", "a"), (4, "one two three four", "en", "a"), (None, "w " * 30000, "de", None)]


def test_sharding_balances_rows_and_keeps_groups(spark):
    rows = [(i, f"text {i}", "en", "a") for i in range(60)] + [(100 + i, "same", "en", "a") for i in range(5)] + [(200 + i, "hot", "en", "a") for i in range(30)]
    out = sharding.shard_documents(documents(spark, rows), n_shards=6).toPandas()
    counts = out.groupby("shard").size()
    assert len(out) == 95 and counts.max() - counts.min() <= 1 and len(counts) == 6
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert out[out.doc_id.between(100, 104)].shard.nunique() == 1
    assert out[out.doc_id >= 200].shard.nunique() <= 3


def test_sharding_of_odd_and_empty_tables(spark):
    out = sharding.shard_documents(documents(spark, ODD), n_shards=3).toPandas()
    assert len(out) == 6 and sorted(out[out.doc_id < 3]["size"]) == [8, 8]
    assert sharding.shard_documents(documents(spark, []), n_shards=3).count() == 0


def brute_lines(rows, ratio, least, distinct):
    """{row number: (text, n_lines, n_dropped)} by plain loops."""
    pages, carry = {}, {}
    for n, (_, text, _, host) in enumerate(rows):
        key = (host, text if distinct else n)
        if key in pages.setdefault(host, set()):
            continue
        pages[host].add(key)
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            carry[host, line] = carry.get((host, line), 0) + 1
    out = {}
    for n, (_, text, _, host) in enumerate(rows):
        if text is None:
            out[n] = (None, 0, 0)
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not x.strip(" ") or not (carry[host, x.strip(" ")] >= least and carry[host, x.strip(" ")] > ratio * len(pages[host]))]
        out[n] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize(("distinct", "most"), [(True, 100_000), (False, 100_000), (True, 0)])
def test_line_dedup_against_brute_force(spark, monkeypatch, distinct, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
    rng = np.random.RandomState(3)
    rows = [(i, "\n".join(f" l{int(k)}" for k in rng.zipf(1.4, rng.randint(1, 9)) % 40), "en", [None, "hot", "hot", "hot", "b", f"tiny{i}"][i % 6]) for i in range(150)]
    rows += [(500 + i, "copy\nof a page", "en", "hot") for i in range(40)] + [(600, None, "en", "b"), (601, "", "en", "b"), (602, "\n \n", None, None)]
    docs = documents(spark, rows).withColumnsRenamed({"n_chars": "h", "size": "host"}).withColumns({"n_lines": F.lit("mine"), "t": F.lit(1), "bad.name": F.col("doc_id")})
    out = line_dedup.drop_boilerplate_lines(docs, 0.2, 2, distinct_pages=distinct)
    assert set(docs.columns) <= {*out.columns} and {"n_lines", "n_dropped"} <= {*out.columns}
    want = brute_lines(rows, 0.2, 2, distinct)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
    assert got == {rows[n][0]: w for n, w in want.items()}
    assert got[500][0] == ("copy\nof a page" if distinct else "")


@pytest.mark.parametrize("clash", ["__host", "__common", "__kept", "row", "kept", "bad", "a.b"])
def test_line_dedup_of_odd_rows(spark, clash):
    out = line_dedup.drop_boilerplate_lines(documents(spark, ODD).withColumn(clash, F.lit(1)))
    assert out.count() == 6 and out.filter("text IS NULL").first().n_lines == 0 and clash in out.columns
    assert line_dedup.drop_boilerplate_lines(documents(spark, [])).count() == 0


def test_line_dedup_stage_keeps_a_page_with_many_copies(spark):
    rows = [(i, "menu\nthe copied page\nits end", "en", "a") for i in range(30)] + [(100 + i, f"menu\nbody {i}", "en", "a") for i in range(60)]
    out = {r.doc_id: r.text for r in stages.line_dedup(spark, documents(spark, rows), "").collect()}
    assert len(out) == 90 and {out[i] for i in range(30)} == {"the copied page\nits end"}
    assert all(out[100 + i] == f"body {i}" for i in range(60))


def test_mixing_comes_to_the_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", f"s{i % 4}") for i in range(400)] + [(1000 + i, "w w w", "en", None) for i in range(5)]
    docs = documents(spark, rows)
    out = mixing.mix_sources(docs).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    by = out.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (abs(by.taken - by.target) <= 1).all()
    assert math.isclose(by.target.sum(), 1.5 * by["size"].sum()) and (by.target <= 2 * by["size"] + 1e-6).all()
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    assert sorted(zip(again.doc_id, again.taken, strict=True)) == sorted(zip(out.doc_id, out.taken, strict=True))


def test_mixing_of_odd_rows(spark):
    out = mixing.mix_sources(documents(spark, ODD)).toPandas()
    assert len(out) == 6 and out[out["size"] == 0].taken.sum() == 0
    assert mixing.mix_sources(documents(spark, [])).count() == 0


def test_first_words(spark):
    row = spark.sql("SELECT ' a  b\tc d' AS t").select(mixing.first_words(F.col("t"), F.lit(2)).alias("x"), mixing.first_words(F.col("t"), F.lit(4)).alias("y")).first()
    assert row.x.split() == ["a", "b"] and row.y.split() == ["a", "b", "c", "d"]


def test_exact_dedup(spark, tmp_path):
    documents(spark, [*ODD, (9, "a b", "en", "a"), (8, "ab", "en", "a"), (7, "a\tb", "en", "b")]).repartition(3).write.parquet(str(tmp_path / "d.parquet"))
    out = exact_dedup.exact_dedup(spark, str(tmp_path / "d.parquet*")).toPandas()
    ab = out[out.doc_id.isin([7, 8, 9])]
    assert len(out) == 9 and set(ab.keep_id) == {7} and set(ab.group_size) == {3} and ab[ab.kept].doc_id.tolist() == [7]
    blank = out[out.doc_id.isin([1, 2, 3])]
    assert set(blank.keep_id) == {3} and blank.kept.sum() == 1  # the most code points
    assert out[out.doc_id == 4].kept.sum() == 1 and out.kept.sum() == 4


def brute_dedup(rows):
    groups = {}
    for d, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), d))
    return sorted((d, min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, d in g)


def test_exact_dedup_in_batches_and_again(spark, tmp_path):
    """Several batches, then a second run with new files on the same state; a digest that texts share."""
    rng = np.random.RandomState(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "cc", "\t"], rng.randint(0, 6))), "en", "a") for i in range(200)] + [(1000 + i, "hot text", "en", "a") for i in range(150)]
    source, weak = str(tmp_path / "d"), lambda norm: F.unhex(F.lpad(F.hex(F.length(norm)), 2, "0"))
    for digest, name in ((exact_dedup.sha256, "strong"), (weak, "weak")):
        path = f"{source}-{name}"
        for n in range(6):
            documents(spark, rows[n::12]).coalesce(1).write.mode("append").parquet(path)
        size = max(f.stat().st_size for f in (tmp_path / f"d-{name}").glob("*.parquet"))
        options = {"checkpoint": str(tmp_path / f"ck-{name}"), "bytes_per_batch": 2 * size, "digest": digest}
        for upto in (6, 12):
            for n in range(6, upto):
                documents(spark, rows[n::12]).coalesce(1).write.mode("append").parquet(path)
            out = exact_dedup.exact_dedup(spark, path, **options).toPandas()
            now = [r for n in range(upto) for r in rows[n::12]]
            assert sorted(zip(out.doc_id, out.keep_id, out.group_size, out.text_sha256, strict=True)) == brute_dedup(now)
            assert out.kept.sum() == len({r[3] for r in brute_dedup(now)}) and (out[out.kept].doc_id == out[out.kept].keep_id).all()
        assert len(list((tmp_path / f"ck-{name}" / "changes").glob("batch=*"))) >= 6


def test_exact_dedup_of_an_empty_table_and_clashing_columns(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "e"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "e")).count() == 0
    documents(spark, ODD).withColumns({c: F.lit("x") for c in ("digest", "keep_id", "file", "at", "norm", "kept")}).write.parquet(str(tmp_path / "c"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "c")).count() == 6


def brute_components(rows, width, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = {d: shingles(t) for d, t, *_ in rows}
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if a != b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, width, percent):
    rng = np.random.RandomState(width)
    base = [" ".join(rng.choice(["Ab", "ba", "cd", "de", "ef", "gh", "hi"], 90)) for _ in range(5)]
    rows = [(1, None, "en", "a"), (2, "one two", "en", "a"), (3, "One  two", "en", "a"), (4, "", "en", "a")]
    for i in range(40):
        words = base[i % 5].split()
        for k in rng.choice(90, i % 6, replace=False):
            words[k] = f"x{rng.randint(30)}"
        rows.append((10 + i, " ".join(words), "en", "a"))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(documents(spark, rows), width, percent).collect()}
    assert out == brute_components(rows, width, percent)


def test_jaccard_join_of_odd_rows(spark):
    out = ngram_jaccard.jaccard_components(documents(spark, ODD), 3, 90).toPandas()
    assert len(out) == 6 and out[out.doc_id == 4].component_id.tolist() == [4, 4] and out[out.doc_id.isna()].component_id.isna().all()


def test_components_of_a_long_shuffled_chain(spark):
    ids = [int(x) for x in np.random.RandomState(0).permutation(1000)]
    edges = [(min(e), max(e)) for e in zip(ids, ids[1:], strict=False)] + [(5000, 5001), (5001, 5002)]
    out = {r.id: r.component for r in ngram_jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(ids, 0), 5000: 5000, 5001: 5000, 5002: 5000}


def test_shingles_are_those_of_the_words():
    a, b, c = shingle_sets([b"A b c d", b"a  B\tc d", b"a b"], 3)
    assert len(a) == 2 and (a == b).all() and len(c) == 1


def test_packing_round_trip(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.RandomState(2)
    rows = [(i, ". ".join(" ".join(rng.choice(["Don't", "été", "x1y2", "naïve so", "<|endoftext|>", "hello,"], 9)) for _ in range(rng.randint(0, 60))), "en", "a") for i in range(80)]
    rows += [(500, None, "en", "a"), (501, "w" * 9000, "en", "a")]
    out = packing.pack_documents(documents(spark, rows), path, window=256).toPandas()
    tok = Tokenizer.from_file(path)
    total = 0
    for doc_id, text, *_ in rows:
        ids = np.append(tok.encode(text or "", add_special_tokens=False).ids, 1).astype("<u4")
        at = 0
        for r in out[out.doc_id == doc_id].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
        total += at
    pad = 0
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        n = seq.length.sum()
        assert n <= 256 and (seq.offset == seq.length.cumsum() - seq.length).all()
        pad += 0 if n & (n - 1) == 0 else 256 - n
    assert pad < 0.1 * total
    assert packing.pack_documents(documents(spark, []), path).count() == 0


def test_best_cuts_are_the_cheapest():
    place, cost = [0, 5, 9, 12, 20, 23, 30], [0, 0, 4, 0, 4, 0, 0]

    def price(cuts):
        total, last = 0, 0
        for i in cuts:
            n = place[i] - place[last]
            if n > 16:
                return 1e9
            total += packing.PER_WINDOW + cost[i] + (0 if n & (n - 1) == 0 else 16 - n)
            last = i
        return total

    subsets = [[i for i in range(1, 6) if mask >> i & 1] + [6] for mask in range(0, 64, 2)]
    assert price(packing.best_cuts(place, cost, 16)) == min(map(price, subsets))


def test_language_id(spark):
    words = {"en": ["the", "thing", "and", "with"], "de": ["nicht", "und", "über", "schön"], "fr": ["été", "nous", "avec", "être"]}
    rng = np.random.RandomState(1)
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang, "a") for i, lang in enumerate(["en", "de", "fr"] * 20)]
    out = language_id.identify(documents(spark, rows + [(900, None, None, "a"), (901, "12 !!", None, "a")]), documents(spark, rows)).select("doc_id", "lang", "language.*").toPandas()
    known = out[out.doc_id < 900]
    assert (known.lang_pred == known.lang).all() and not known.rejected.any() and known.score.between(0, 1).all()
    none = out[out.doc_id >= 900]
    assert set(none.lang_pred) == {"und"} and none.rejected.all() and set(none.score) == {0.0}


def test_quality(spark):
    rng = np.random.RandomState(1)
    good = [(i, " ".join(rng.choice(["calm", "clear", "plain", "text"], 40)), "en", "a") for i in range(60)]
    bad = [(100 + i, " ".join(w + "!!" for w in rng.choice(["calm", "clear", "plain", "text"], 40)), "en", "a") for i in range(60)]
    labels = spark.createDataFrame([(d, int(d < 100), 0) for d, *_ in good + bad if d % 3], "doc_id long, quality int, toxic int")
    out = quality.classify(documents(spark, good + bad + [(999, None, "en", "a")]), labels).toPandas()
    assert len(out) == 121 and out[out.doc_id < 100].predicted.all() and not out[out.doc_id.between(100, 200)].predicted.any()
    assert out.score.between(0, 1).all()


PAGE = (
    '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Menu {i}</a></li></ul></nav><div class="ad">Buy now {i}</div>'
    "<article><h1>Title {i}</h1><p>First &amp; long sentence number {i} of the story, with many more words.<br>It goes on<p>Second  paragraph\n{i}.</article>"
    "<footer>&copy; Nobody {i}</footer></body></html>"
)


def test_html_extraction(spark):
    pages = spark.createDataFrame([(i, "http://a", PAGE.format(i=i), "x") for i in range(60)] + [(100, "u", None, "x"), (101, "u", "", "x")], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_extract.extract(pages).collect()}
    want = "Title 7\n\nFirst & long sentence number 7 of the story, with many more words. It goes on\n\nSecond paragraph 7."
    assert out[7].text == want and out[7].n_chars == len(want) and out[100].text == "" and out[101].n_chars == 0


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ("<html><head><title>t</title><meta charset=x><body><p>a</p><p>b</body></html>", ["a", "b"]),
        ("<head><title>t</title><link rel=x><h1>a</h1><p>b", ["a", "b"]),
        ("<head><title>t</title>a<p>b", ["a", "b"]),
        ("<head><template><p>no</p></template><noscript><p>no</p></noscript><script>no</script></head><body><p>a", ["a"]),
        ("<p>a</p><![foo x]>b<p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><![ x]>b<![CDATA[no]]><p>c</p><![if !IE]>d<![endif]>", ["a", "b", "c", "d"]),
        ("<article><p>a <math><mi>x</mi></math> b<svg><text>c</text></svg></p><button>d</button><object>e</object></article>", ["a x bc", "d", "e"]),
    ],
)
def test_leaves_of_odd_pages(html, texts):
    assert [text for _, text, _ in html_extract.leaves(html)] == texts


def nearest_recall(out, x, ids, k):
    hit = 0
    for q, part in out.groupby("query_id"):
        s = x.astype(float) @ x[ids.index(q)].astype(float)
        order = [ids[i] for i in np.lexsort((ids, -np.round(s, 9))) if ids[i] != q][:k]
        hit += len(set(order) & set(part.vec_id))
        assert np.allclose([s[ids.index(v)] for v in part.sort_values("rank").vec_id], part.sort_values("rank").score)
    return hit / max(1, len(out))


def test_nearest_neighbours(spark):
    rng = np.random.RandomState(4)
    x = rng.randn(400, 8).astype(np.float32)
    x[10:30] = x[10]  # ties
    rows = [(i, [float(v) for v in x[i]], "x") for i in range(400)] + [(400, None, "x"), (420, [0.0] * 8, "x"), (440, [float("nan")] * 8, "x"), (460, [None] * 8, "x"), (None, [1.0] * 8, "x")]
    out = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string"), k=5).toPandas()
    assert sorted(set(out.query_id)) == list(range(0, 400, 20)) and (out.groupby("query_id").size() == 5).all()
    assert nearest_recall(out, x, list(range(400)), 5) >= 0.9
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = nearest.nearest(spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.5, 0.2]), (2, [1e-3 / 3, 1.0])], "vec_id long, embedding array<double>")).toPandas()
    assert few.vec_id.tolist() == [1, 2] and few.score.tolist() == [0.5 + 0.1 * 0.2, 1e-3 / 3 + 0.1]  # double vectors aren't rounded


def test_nearest_neighbours_of_clusters_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 64)
    rng = np.random.RandomState(9)
    centres = rng.randn(20, 64) * 3
    x = (centres[rng.randint(20, size=1200)] + rng.randn(1200, 64)).astype(np.float32)
    x[300:700] = x[300]  # a hot vector
    out = nearest.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).toPandas()
    assert len(out) == 60 * 20 and nearest_recall(out, x, list(range(1200)), 20) >= 0.9


def test_rows_come_by_projected_distance_and_some_are_never_verified(spark):
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()])
    ids = np.arange(len(x))
    space = nearest.Space(x.shape[1], float(np.sqrt((x * x).sum(1).max())), np.random.RandomState(17).randn(x.shape[1] + 1, nearest.PROJECTED))
    block = nearest.Block(space, ids, x)
    hits = verified = asked = 0
    for n in ids[::20]:
        p = space.project_queries(x[n][None])[0]
        parts = list(block.by_distance(p))
        rows, far = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        assert sorted(rows) == ids.tolist() == sorted(block.ids) and (np.diff(far) >= 0).all()
        assert np.allclose(far, ((block.p[rows] - p) ** 2).sum(1))
        near, score, some = block.search(20, n, x[n], np.inf)
        product = x @ x[n]
        product[n] = -np.inf
        assert np.allclose(score, product[near]) and n not in near
        hits, verified, asked = hits + (product[near] >= np.sort(product)[-20] - 1e-9).sum(), verified + some, asked + 1
    assert hits / asked / 20 >= 0.9
    assert verified / asked / len(x) < 0.8


def test_the_stop_is_the_quantile_of_the_test():
    assert abs(float(nearest.chi_square_cdf(nearest.STOP)) - nearest.SURE) < 1e-9
    draws = (np.random.RandomState(1).randn(20_000, nearest.PROJECTED) ** 2).sum(1)
    assert abs((draws < nearest.STOP).mean() - nearest.SURE) < 0.01


def test_nearest_neighbours_of_repeated_ids_unequal_lengths_and_many_shares(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_ROWS", 2)
    monkeypatch.setattr(nearest, "LEAF_ROWS", 16)
    rows = [(0, [1.0, 0.0]), (0, [0.9]), (20, [1.0, 0.0, 0.0]), (3, [0.0, 0.0, 5.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (None, [1.0])]
    rows += [(100 + n, [1.0, 0.0]) for n in range(60)]
    out = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).toPandas()
    got = out[out.query_id == 20].sort_values("rank")
    assert got.vec_id.tolist() == [0, 100, 101, 102] and got.score.tolist() == [1.0] * 4
    assert not (out.query_id == out.vec_id).any()
    # both rows of id 0 ask, as one query; what the better one finds comes first
    assert out[out.query_id == 0].sort_values("rank").vec_id.tolist()[0] == 20
    assert set(out.query_id) == {0, 20} | {100 + n for n in range(60) if not (100 + n) % 20}
