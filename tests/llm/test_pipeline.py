"""The stages of corpus_pipeline.py against brute force on a small corpus, and the whole run."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm import language_id, mixing, stages
from tests.llm.test_operators import ODD, brute_components, brute_lines, documents

WORDS = {"en": ["the", "thing", "and", "with", "from"], "de": ["nicht", "und", "über", "schön", "aber"]}


def corpus():
    rng = np.random.RandomState(8)
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        body = " ".join(rng.choice(WORDS[lang], 40)) + f" id{i}"
        rows.append((i, f"menu of the site\n{body}" if i % 3 else body, lang, f"s{i % 3}"))
    rows += [(100 + i, rows[1][1], "de", "s1") for i in range(5)] + [(200, rows[2][1] + " more", "en", "s2"), (300, None, "en", "s0"), (301, "123 456", None, "s0"), (302, "", None, None)]
    return rows


def plain(rows):
    return [(r[0], r[1], r[2], r[3]) for r in rows]


def test_language_stage(spark):
    rows = corpus()
    docs = documents(spark, rows)
    model = language_id.fit(docs)
    got = {r.doc_id: r.lang for r in stages.language_id(spark, docs, "").collect()}
    want = model.predict([r[1] for r in rows])
    assert got == {r[0]: p for r, p, no in zip(rows, want.lang_pred, want.rejected, strict=True) if not no}
    assert not {300, 301, 302} & set(got) and len(got) == 66


def test_line_stage(spark):
    rows = corpus()
    want = brute_lines(rows, 0.05, 2, True)
    got = stages.line_dedup(spark, documents(spark, rows), "").collect()
    assert {r.doc_id: r.text for r in got} == {rows[n][0]: w[0] for n, w in want.items()}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got) and "menu of the site" not in {r.text.split("\n")[0] for r in got if r.text}


def test_jaccard_stage(spark):
    rows = corpus()
    found = brute_components(rows, 5, 80)
    got = stages.ngram_jaccard_join(spark, documents(spark, rows), "").collect()
    assert {r.doc_id for r in got} == {d for d, (_, c) in found.items() if c == d} and len(got) < len(rows)


def test_mixing_stage(spark):
    docs = documents(spark, corpus())
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix_sources(docs).collect()}
    text = {r[0]: r[1] for r in corpus()}
    got = {}
    for r in stages.mixing(spark, docs, "").collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.text is None or r.n_chars == len(r.text)
    for d, (n, size) in taken.items():
        if not size:
            assert got[d] == [text[d]]
            continue
        words = text[d].split()
        copies = sorted((t.split() for t in got.get(d, [])), key=len, reverse=True)
        assert sum(map(len, copies)) == n and all(c == words[: len(c)] for c in copies) and all(c == words for c in copies[: n // size])


def test_packing_stage(spark):
    tok = Tokenizer.from_file(public_tokenizers.path(stages.TOKENIZER))
    out = stages.packing(spark, documents(spark, corpus()), "").toPandas()
    for d, text, *_ in corpus():
        ids = np.append(tok.encode(text or "", add_special_tokens=False).ids, 1).astype("<u4")
        pieces = out[out.doc_id == d].sort_values("start")
        assert pieces.length.sum() == len(ids) and [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(pieces.start, pieces.length, strict=True)] == pieces.ids_crc32.tolist()


@pytest.mark.parametrize("k", range(5))
def test_stages_of_odd_and_empty_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    odd = stage(spark, documents(spark, ODD), "")
    assert odd.columns[:1] == ["doc_id"] and (name == "packing" or odd.columns == stages.COLUMNS)
    kept = {"language_id": 3, "line_dedup": 6, "ngram_jaccard_join": 5, "mixing": None, "packing": None}[name]
    assert kept is None or odd.count() == kept
    assert stage(spark, documents(spark, []), "").count() == 0


def test_the_whole_run(spark, tmp_path):
    rows = corpus()
    documents(spark, rows).drop("size").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    clean = brute_lines([r for r in rows if r[0] not in (300, 301, 302)], 0.05, 2, True)
    texts = dict(zip([r[0] for r in rows if r[0] not in (300, 301, 302)], (w[0] for w in clean.values()), strict=True))
    lead = brute_components([(d, t) for d, t in texts.items()], 5, 80)
    assert set(out.doc_id) <= {d for d, (_, c) in lead.items() if c == d}
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", texts[d])) for d, (_, c) in lead.items() if c == d)
    tok = Tokenizer.from_file(public_tokenizers.path(stages.TOKENIZER))
    full = {d: len(tok.encode(texts[d], add_special_tokens=False).ids) + 1 for d in set(out.doc_id)}
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert all(n <= full[d] for d, n in zip(out.doc_id, out.doc_tokens, strict=True))
    assert abs(out.length.sum() / sum(full.values()) / (1.5 * words / sum(len(texts[d].split()) for d in full)) - 1) < 0.1
