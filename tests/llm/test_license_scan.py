from __future__ import annotations

import math
import random

import pytest

from platewise.llm import license_scan

SF = "/root/testdata/sf0.001"


def brute_force(text, templates, phrases, least, width):
    words = license_scan.words_of(text or "")
    places = {}
    for phrase, label in phrases:
        p = license_scan.words_of(phrase)
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.setdefault(i, set()).add(label)
    matches = []
    for t, (label, own) in enumerate(license_scan.passages(templates, width)):
        own = set(own)
        for at in range(0, max(1, len(words)), width // 2):
            shared = len(own & set(words[at : at + width]))
            if shared >= math.ceil(least * len(own) - 1e-9):
                matches.append((label, t, at, shared / len(own)))
    told = set().union(*places.values()) if places else set()
    n = sum(len(x) for x in places.values())
    score = 1.0 if n else max((m[3] for m in matches), default=0.0)
    return len(words), n, min(places, default=None), max(places, default=None), sorted(told), sorted(matches, key=lambda m: (m[2], m[1])), sorted(told | {m[0] for m in matches}), score


def found(frame):
    return {r.doc_id: (r.ls_words, r.ls_places, r.ls_first, r.ls_last, r.ls_phrases, [tuple(m) for m in r.ls_matches], r.ls_labels, r.ls_score) for r in frame.collect()}


@pytest.mark.parametrize(("least", "width"), [(0.5, 8), (0.75, 12), (1.0, 6)])
def test_equals_brute_force(spark, least, width):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(12)] + ["é", "mit", "license", "apache"]
    draw = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    templates = [(f"l{i % 4}", draw(rng.randint(1, 14))) for i in range(12)]
    texts = [draw(rng.randint(0, 80)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = found(license_scan.scan_licenses(docs, templates, least=least, width=width))
    assert got == {i: brute_force(t, templates, license_scan.PHRASES, least, width) for i, t in enumerate(texts)}


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = found(license_scan.scan_licenses(docs))
    want = {r.doc_id: brute_force(r.text, license_scan.TEMPLATES, license_scan.PHRASES, 0.9, 64) for r in docs.collect()}
    assert got == want
    assert any("cc-by-nc" in r[6] for r in want.values())


def test_rarest_words_make_the_prefixes():
    index = license_scan.build_index([("x", "the rare word")], [], {"the": 90, "word": 5, "rare": 1}, 0.6, 64)
    assert index.tokens == [b"rare", b"word", b"the"]
    assert [list(p) for p in index.postings] == [[0, 0], [0, 1]]  # two of three words are needed: a prefix of two


def test_filters_keep_only_pairs_that_can_qualify(spark):
    docs = spark.createDataFrame([(1, "the mit of the license under"), (2, "RELEASED under/the MIT-License!"), (3, "released under the mit")], "doc_id long, text string")
    got = found(license_scan.scan_licenses(docs))
    assert [got[i][6] for i in (1, 2, 3)] == [[], ["mit"], []]
    assert got[2][1:4] == (1, 3, 3) and got[2][5] == [("mit", 0, 0, 1.0)]


def test_odd_rows(spark, odd):
    long = "word " * 700_000 + "Licensed under CC BY-NC 4.0."
    more = spark.createDataFrame([(20, long, "en", "a", "x"), (21, None, None, None, None)], odd.schema)
    rows = license_scan.scan_licenses(odd.withColumn("ls_score", odd["doc_id"]).unionByName(more, allowMissingColumns=True)).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows}
    assert by[20].ls_labels == ["cc-by-nc"] and by[20].ls_words == 700_007 and by[20].ls_score == 1.0
    assert (by[21].ls_words, by[21].ls_first, by[21].ls_labels, by[21].ls_score, by[21].key) == (0, None, [], 0.0, None)
    assert by[None].ls_words == 8
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0
    assert license_scan.scan_licenses(odd, templates=()).count() == 11
    with pytest.raises(ValueError):
        license_scan.scan_licenses(odd, templates=(), phrases=())
