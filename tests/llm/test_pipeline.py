"""The stages of the corpus pipeline next to brute force, each on its own input."""

from __future__ import annotations

import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as pipeline  # noqa: E402
from wardlight.llm import pii, quality, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    sets, of = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]) and of[a] != of[b]:
                old, new = max(of[a], of[b]), min(of[a], of[b])
                of = [new if x == old else x for x in of]
    return of


def test_no_text_is_lost_with_repeated_ids(spark):
    rng = random.Random(4)
    text = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(4)]
    near = text[0].replace(text[0].split()[40], "else")
    rows = [(1, text[0]), (2, near), (2, text[1]), (3, text[2]), (3, text[3]), (None, text[3]), (None, "alone here"), (5, None), (6, ""), (6, "")]
    got = pipeline.near_duplicates(spark, frame(spark, rows), SF).collect()
    want = [(1, text[0]), (2, text[1]), (3, text[2]), (3, text[3]), (None, "alone here"), (5, None), (6, ""), (6, "")]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_near_duplicates_of_the_small_tables(spark):
    docs = queries.table(spark, SF, "documents")
    rows = docs.collect()
    of = groups([r.text for r in rows])
    best = {}
    for g, r in zip(of, rows):
        best[g] = min(best.get(g, r.doc_id), r.doc_id)
    got = pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(best.values())
    assert {r.doc_id: r for r in got}.items() <= {r.doc_id: r for r in rows}.items()


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = queries.table(spark, SF, "documents"), []
    for _, stage in pipeline.STAGES:
        out.append(docs)
        docs = pipeline.keep(stage(spark, docs, SF))
    return [*out, docs]


def test_columns_stay(stages):
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * 5


def test_rejected_documents_go(spark, stages):
    model = pipeline.quality_model(stages[0], queries.table(spark, SF, "labels"))
    good = {r.id for r in quality.score(stages[0], "doc_id", "text", model).collect() if r.score >= pipeline.ACCEPT}
    assert {r.doc_id for r in stages[1].collect()} == good


def test_test_passages_go(spark, stages):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for item in queries.table(spark, SF, "benchmark").collect():
        w = pattern.findall((item.text or "").translate(LOWER))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert after.keys() == before.keys()

    def hit(text):
        w = pattern.findall((text or "").translate(LOWER))
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    assert any(hit(t) for t in before.values())
    for i, r in after.items():
        assert not hit(r.text) and r.n_chars == len(r.text or "")
        assert r.text == before[i] or hit(before[i])


def test_personal_data_goes(spark, stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    want = {r.doc_id: r.text for r in pii.pseudonymize(stages[3], "text", found_col="f").collect()}
    rows = stages[4].collect()
    after = {r.doc_id: r.text for r in rows}
    assert after == want and any(after[i] != before[i] for i in after)
    assert all(r.n_chars == len(r.text or "") for r in rows)


def test_what_is_left_is_packed_whole(stages):
    pieces = stages[5].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in stages[4].collect()}
    by = {}
    for r in pieces:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert sum(r.length for r in own) <= 2048
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]


def test_an_empty_table(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
