"""Every stage of the pipeline against plain loops, and the whole run."""

import random

import numpy as np
import pytest

import corpus_pipeline
from netpen.llm import quality
from tests.llm.test_bpe import library
from tests.llm.test_minhash import first_ids
from tests.llm.test_mixing import goals, size
from tests.llm.test_quality import reference
from tests.llm.test_secrets import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    pick = random.Random(21)
    words = [f"{a}{b}" for a in ("lo", "ka", "mir", "te", "su") for b in ("n", "sta", "rel", "o", "vi", "me")]
    rows = []
    for i in range(260):
        text = " ".join(pick.choice(words) for _ in range(pick.randrange(15, 200)))
        if i % 9 == 0:
            text += " password = 'abcdefghijklmnop' deadbeefdeadbeef"
        if i % 31 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        if i % 7 == 0 and rows:
            text = rows[pick.randrange(len(rows))][1]
        if i % 11 == 0 and rows:
            text = rows[-1][1] and rows[-1][1] + " more"
        rows.append((i, text, ["en", "de"][i % 2], f"s{i % 5}", 0))
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (7, rows[7][1], "de", "s2", 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def ordered(rows):
    return sorted([tuple(r) for r in rows], key=repr)


def test_quality_rules(llm):
    rows = documents()
    _, failed, distance = reference([(i, t, lang, source) for i, t, lang, source, _ in rows])
    want = [r for r, f, d in zip(rows, failed, distance) if not f and (d is None or d <= quality.CUT)]
    got = corpus_pipeline.quality_rules(llm, frame(llm, rows), "").collect()
    assert ordered(got) == ordered(want) and len(want) < len(rows)


def test_near_dedup(llm):
    """Against an exact similarity of shingles and connected components."""
    rows = documents()
    got = corpus_pipeline.near_dedup(llm, frame(llm, rows), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == first_ids([r[:2] for r in rows])
    assert {tuple(r) for r in got} <= set(rows) and len(got) < len(rows)


def test_secret_scan(llm):
    rows = documents()
    got = corpus_pipeline.secret_scan(llm, frame(llm, rows), "").collect()
    clean = [r for r in rows if not brute(r[1])]
    kept = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert {r[0] for r in rows if brute(r[1])} == {r.doc_id for r in got if r.text and "[secret]" in r.text}
    for i, text, *_ in clean:
        assert kept[i].text == text and kept[i].n_chars == (None if text is None else len(text))
    assert not any(brute(r.text) for r in got)


def test_source_mix(llm):
    rows = documents()
    got = corpus_pipeline.source_mix(llm, frame(llm, rows), "").collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        assert r.n_chars == len(r.text)
    assert all(abs(taken.get(s, 0) - t) < 1 for s, t in goals(sizes).items())
    texts = {(r[0], r[1]) for r in rows}
    parts = [r for r in got if (r.doc_id, r.text) not in texts]
    assert len(parts) <= len(sizes)  # at most one text of a source is cut
    for r in parts:
        assert any(" ".join((t or "").split()).startswith(r.text) for i, t in texts if i == r.doc_id)


def test_token_ids(llm):
    rows = documents()
    got = corpus_pipeline.token_ids(llm, frame(llm, rows), "").collect()
    assert ordered([(r.doc_id, r.lang, r.source, r.n_tokens, np.frombuffer(r.token_ids, "<u4").tolist(), r.decodes)
                    for r in got]) == ordered(
        [(i, lang, source, len(library(t)[0]), library(t)[0], True) for i, t, lang, source, _ in rows])


@pytest.mark.parametrize("rows", [documents()[:90], []], ids=["some", "none"])
def test_run(llm, tmp_path, rows):
    """The stages one after the other; each alone is held against loops above."""
    frame(llm, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(llm, str(tmp_path)).collect()
    assert bool(got) == bool(rows) and all(r.decodes for r in got)
    kept = {r.doc_id: (r.lang, r.source) for r in got}
    assert all(kept[i] == (lang, source) for i, _, lang, source, _ in rows if i in kept)
    words = {i: size(t) for i, t, *_ in rows}
    assert all(words[r.doc_id] >= 20 and r.n_tokens > 0 for r in got)
