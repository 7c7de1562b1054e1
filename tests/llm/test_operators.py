from __future__ import annotations

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platewise.llm import bpe_chunks, cotraining, fingerprints, line_dedup, mixing, near_dedup, quality_rules, suffix_dedup, toxicity, warc
from platewise.llm.queries import word_bpe_path
from platewise.llm.text_arrays import byte_columns, span_hash

SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- near-dedup
def test_dart_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 60, 900, dtype=np.uint64), rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    both = np.concatenate([a[:600], a[300:], b[:0]])
    sig = near_dedup.dart_minhash(both, np.repeat([0, 1], 600), 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - 300 / 900) < 0.06


def test_weighted_darts_follow_weights():
    x = np.arange(40, dtype=np.uint64) * np.uint64(7919)
    w = np.concatenate([np.full(40, 2.0), np.full(40, 3.0)])
    sig = near_dedup.dart_minhash(np.concatenate([x, x]), np.repeat([0, 1], 40), 2, 1024, w)
    assert abs((sig[0] == sig[1]).mean() - 2 / 3) < 0.06


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect())
    sets = []
    for r in rows:
        w = (r.text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {r.doc_id: rows[find(i)].doc_id for i, r in enumerate(rows)}


def test_near_duplicates_odd_rows(spark, odd):
    got = [(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(odd).collect()]
    assert len(got) == 11
    cls = dict(got)
    assert cls[4] == cls[5] == 4 and cls[6] == cls[7] == 6 and cls[None] is None
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_texts_of_one_doc_id_share_a_class(spark):
    one, two, other = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(2, one), (3, two), (5, one), (5, two), (7, other)], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect())) == [(2, 2), (3, 2), (5, 2), (5, 2), (7, 7)]


def test_weighted_near_duplicates(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join(base + base[:5] * 30)), (3, " ".join(base + base[:5] * 31))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1}  # as sets all alike
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, weighted=True).collect()} == {1: 1, 2: 2, 3: 2}


def test_similarities_equal_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 25))) for _ in range(30)]
    pairs = [(i, j) for i in range(30) for j in range(30)]
    for weighted in (False, True):
        bags = []
        for t in texts:
            w = t.split()
            bag = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
            bags.append(bag if weighted else Counter(set(bag)))
        got = near_dedup.similarities(near_dedup.shingle_sets([t.encode() for t in texts], weighted), *(np.array(x) for x in zip(*pairs, strict=True)))
        assert got == pytest.approx([sum((bags[i] & bags[j]).values()) / sum((bags[i] | bags[j]).values()) for i, j in pairs])


@pytest.mark.parametrize("block", [256, 16])
def test_near_duplicates_of_drifting_copies(spark, monkeypatch, block):
    """A chain of copies, each like the next and unlike most others, among unlike texts of one template."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(11)
    words = [f"t{i}" for i in range(200)]
    rows, ids = [], rng.sample(range(10**6), 160)
    for i in range(120):
        words = list(words)
        for j in range(4):
            words[(7 * i + 3 * j) % 200] = f"n{i}x{j}"
        rows.append((ids[i], " ".join(words)))
    rows += [(ids[120 + i], " ".join(w if k % 6 else f"u{i}y{k}" for k, w in enumerate(words))) for i in range(40)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {i: find(i) for i in sets}


def template_texts(groups: int, planted: int) -> list[tuple[int, str]]:
    """Texts on one template with mutual similarity near 0.7, and copies of the last ones at 0.81, all with random ids."""
    rng = random.Random(7)
    base = [f"t{i}" for i in range(304)]

    def spoil(words, holes, tag):
        out = list(words)
        for h, at in enumerate(rng.sample(range(2, 300, 6), holes)):
            out[at] = f"{tag}x{h}"
        return out

    texts = [spoil(base, 5, f"d{i}") for i in range(groups)]
    texts += [t[:-31] + [f"p{i}y{j}" for j in range(31)] for i, t in enumerate(texts[-planted:])]
    ids = rng.sample(range(1, 10**6), len(texts))
    return [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]


def test_near_duplicates_of_a_crowded_bucket(spark):
    rows, planted = template_texts(400, 60), 60
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert planted <= len(links) < 2 * planted
    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    keys = near_dedup.bands(near_dedup.dart_minhash(*near_dedup.shingles(*byte_columns(pa.array([t for _, t in rows]))), len(rows), near_dedup.BANDS * near_dedup.ROWS))
    by_id = {i: set(k.tolist()) for (i, _), k in zip(rows, keys, strict=True)}
    assert all(by_id[i] & by_id[j] for i, j in links) and max(Counter(k for s in by_id.values() for k in s).values()) > 100
    got = dict(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()))
    assert got == {i: find(i) for i in sets}


# --- WARC
def test_warc_round_trip(spark):
    rows = [(1, "u1", "<p>\r\n\r\nWARC/1.1 not a record</p>"), (2, "u2", "same"), (3, "u3", "same"), (4, None, None), (5, "u", ""), (None, "n", "same"), (3, "u3", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_pages(pages).collect()
    assert len(got) == 7
    types = defaultdict(list)
    for r in got:
        types[r.page_id].append((r.record_type, r.refers_to, r.payload_bytes))
    assert types[2] == [("revisit", 3, 4)] and types[3] == [("response", None, 4)] * 2 and types[None] == [("revisit", 3, 4)]
    assert types[4] == [("revisit", 5, 0)] and types[5] == [("response", None, 0)]
    one = next(r for r in got if r.page_id == 1)
    assert bytes(one.payload).decode() == rows[0][2]
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_rewrite_keeps_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"body {i % 3}") for i in range(9)], "page_id long, url string, html string")
    warc.archive_pages(pages, path=f"file://{tmp_path}/a")
    warc.rewrite_archives(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    pick = lambda p: sorted((r.page_id, r.record_type, r.refers_to or -1, r.payload_digest) for r in warc.read_archives(spark, f"file://{tmp_path}/{p}").collect())
    assert pick("a") == pick("b")


# --- substring dedup
def brute_spans(rows):
    seen, out = set(), {}
    for doc, text in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for s in range(len(body) - 99):
            w = body[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        out[doc] = (sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), bytes(b for b, g in zip(body, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("block", [2048, 4])
def test_substrings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", block)
    random.seed(5)
    passage, run = "".join(random.choice("abcdef ") for _ in range(150)), "ab" * 150
    rows = [(i, "".join(random.choice("ab") for _ in range(random.randint(0, 90))) + passage[: random.randint(99, 150)] + (run[: random.randint(0, 250)] if i % 3 == 0 else "")) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "é" * 200)]
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_spans(rows)


def test_substrings_odd_rows(odd):
    assert suffix_dedup.dedup_substrings(odd).count() == 11
    assert suffix_dedup.dedup_substrings(odd.limit(0)).count() == 0


def test_merged_transforms_order_all_suffixes():
    texts = [b"banana bandana", b"ananas", b"bandana", b"nab"]
    keep = suffix_dedup.repeated_windows([t + b"x" * 120 for t in texts], np.array([len(t) + 21 for t in texts]), [(i, 0) for i in range(4)])
    windows = Counter((t + b"x" * 120)[w : w + 100] for t, k in zip(texts, keep, strict=True) for w in k)
    every = {(t + b"x" * 120)[w : w + 100] for t in texts for w in range(len(t) + 21)}
    assert set(windows) == every and max(windows.values()) == 1


# --- line dedup
def test_line_dedup_odd_rows(odd):
    got = {(r.doc_id, r.text): (r.ld_text, r.ld_lines, r.ld_dropped) for r in line_dedup.dedup_lines(odd).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[1] == ("alpha beta gamma delta epsilon", 2, 1) and by_id[2] == ("\nother", 3, 1) and by_id[3][2] == 0
    assert by_id[4] == ("", 1, 0) and by_id[5] == ("", 1, 0)
    assert line_dedup.dedup_lines(odd).columns[:5] == odd.columns
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_twice_seen_holds_every_repeat():
    rng = np.random.default_rng(2)
    seen, x = line_dedup.TwiceSeen(1 << 12), rng.integers(0, 1 << 60, 5000, dtype=np.uint64)
    seen.add(x)
    seen.add(x[:500])
    at, bits = line_dedup._slots(x[:500], 1 << 12)
    assert ((seen.twice[at] & bits) == bits).all()


# --- hashes
def thue_morse(n: int) -> tuple[str, str]:
    """A word and its complement: polynomial hashes modulo 2**64 can't tell them apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_crafted_texts_are_told_apart():
    one, two = thue_morse(1024)
    assert quality_rules.statistics(*byte_columns(pa.array([one + "\n" + two])))[0][0].tolist() == brute_counts(one + "\n" + two)
    one, two = thue_morse(2048)
    text = " ".join(f"w{i}" for i in range(7)) + f" {one} " + " ".join(f"w{i}" for i in range(7)) + f" {two}"
    assert quality_rules.statistics(*byte_columns(pa.array([text])))[0][0].tolist() == brute_counts(text)
    assert near_dedup.similarities(near_dedup.shingle_sets([one.encode(), two.encode()]), np.array([0]), np.array([1]))[0] == 0
    data, offsets = byte_columns(pa.array([one, two]))
    assert len(set(suffix_dedup.occurrences(data, offsets)[4].tolist())) > 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=40), min_size=1, max_size=12))
def test_span_hashes_are_equal_for_equal_bytes_only(texts):
    data, offsets = byte_columns(pa.array(texts))
    hashes = span_hash(data, offsets[:-1], offsets[1:])
    assert len(set(hashes.tolist())) == len(set(texts)) == len(set(zip(texts, hashes.tolist(), strict=True)))


# --- quality rules
def brute_counts(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    tally = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if tally[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab #|é\n\t", max_size=80), min_size=1, max_size=6))
def test_rule_statistics_equal_brute_force(texts):
    counts, _ = quality_rules.statistics(*byte_columns(pa.array(texts)))
    assert counts.tolist() == [brute_counts(t) for t in texts]


def test_isolation_forest_finds_outliers():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (500, 3)), rng.normal(9, 1, (10, 3))])
    score = quality_rules.IsolationForest(100).fit(x).score(x)
    assert score[500:].min() > np.quantile(score[:500], 0.98)


def test_rules_odd_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(odd.select("doc_id", "text", "key"), labels).collect()
    assert len(got) == 11 and all(r.kept == (not r.base_failed) for r in got)


def test_rules_learn_from_every_labelled_row(spark):
    from pyspark.sql import functions as F

    from platewise.llm.sampling import seeded_order

    # the bad rows come after the first 4,000 in the order of the former sample
    ids = [r.id for r in spark.range(4300).orderBy(seeded_order(F.col("id"), 7), "id").collect()]
    text = lambda i, bad: " ".join(f"w{i + j}{'#$' * bad}" for j in range(25))
    docs = spark.createDataFrame([(i, text(i, at >= 4150)) for at, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(at < 4150)) for at, i in enumerate(ids)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert not any(got[i] for i in ids[4150:]) and sum(not got[i] for i in ids[:4150]) <= int(0.002 * 4150)


# --- quality classifier
def test_co_training_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 3 > 0")
    got = cotraining.classify_quality(docs, known).join(labels.where("doc_id % 3 = 0"), "doc_id").select("quality", "ct_kept", "ct_score").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.ct_kept for r in good) >= 0.97 * len(good) and sum(r.ct_kept for r in bad) <= 0.3 * len(bad)


def test_co_training_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = cotraining.classify_quality(odd, labels)
    assert got.columns[:5] == odd.columns and got.where("ct_kept").count() == 11


# --- fingerprints
def test_fingerprints_follow_neighbours(spark, odd):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.where("doc_id is not null and doc_id <> 5").collect()))
    got = {r.doc_id: r for r in fingerprints.fingerprint_neighbours(odd.where("doc_id is not null and doc_id <> 5")).collect()}
    for i, (doc, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(i + 1) % len(rows)][1]
        assert got[doc].edited_sha256 == sha(text[: len(text) - half] + after[:half]) and got[doc].n_chars == len(text)
    assert got[6].near_next > 0.5  # a text of few distinct phrases, and the same text with another end
    assert fingerprints.fingerprint_neighbours(odd).count() == 11 and fingerprints.fingerprint_neighbours(odd.limit(0)).count() == 0


def test_equal_substrings_share_names():
    rng = np.random.default_rng(8)
    body = bytes(rng.integers(97, 123, 4000, dtype=np.uint8))
    a, b = (fingerprints.sketches(*byte_columns(pa.array([t], pa.binary()))) for t in (body, b"shifted by an odd head " + body))
    assert fingerprints.likeness(a, b)[0] > 0.9


# --- mixing
def test_flow_prefers_first_copies():
    flow = mixing.min_cost_flow({"ab": 10, "a": 10, "b": 4}, {"ab": ["a", "b"], "a": ["a"], "b": ["b"]}, {"a": 14, "b": 12})
    assert sum(flow.values()) == 26 and sum(f for (_, _, layer), f in flow.items() if layer == 1) == 2


def test_targets_share_and_stop():
    got = mixing.source_targets({"a": 100, "b": 10, None: 50})
    assert got["a"] == pytest.approx(132) and got["b"] == pytest.approx(20) and got[None] == pytest.approx(88) and sum(got.values()) == pytest.approx(240)


@pytest.mark.parametrize(("sf", "share"), [("sf0.001", 0.04), ("sf0.01", 0.01)])  # 10 and 50 documents a source
def test_mixture_meets_targets(spark, sf, share):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = mixing.mix_to_targets(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_to_targets(docs).collect()))
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.mx_copies <= 2
        taken[r.mx_pattern] += r.mx_copies * r.mx_size
        target[r.mx_pattern] = r.mx_target
    assert all(abs(taken[p] - t) <= max(40, share * t) for p, t in target.items())


def test_mixture_odd_rows(odd):
    got = mixing.mix_to_targets(odd).collect()
    assert len(got) == 11 and all(r.mx_copies == 0 for r in got if r.mx_size == 0)
    assert mixing.mix_to_targets(odd.limit(0)).count() == 0


# --- toxicity
def test_convolution_learns_planted_words():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 5000, rng.integers(20, 80)).astype(np.int32) for _ in range(800)]
    y = (np.arange(800) % 5 == 0).astype(int)
    for i in np.flatnonzero(y):
        docs[i][3] = 6000 + i % 4
    net = toxicity.ConvClassifier().fit(docs[:600], y[:600])
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs[600:]])])
    logit = net.logit(np.concatenate(docs[600:]), starts)
    assert logit[y[600:] == 1].min() > np.quantile(logit[y[600:] == 0], 0.97)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 10)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == 11 and all(0 <= r.tx_score <= 1 for r in got)
    many = spark.createDataFrame([(i, "plain words here" if i % 2 else "nasty word", "en") for i in range(40)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id % 2, r.tx_score >= 0.5) for r in toxicity.score_toxicity(many, marks).collect()} == {(0, True), (1, False)}


# --- BPE
@pytest.fixture(scope="module")
def encoder():
    return bpe_chunks.ChunkEncoder(bpe_chunks.tokenizer_text(word_bpe_path()), mean=24)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB's 1!\ń é<|endoftext|>")), max_size=200))
def test_chunks_encode_exactly(encoder, text):
    raw = text.encode()
    cuts = bpe_chunks.cut_points(np.frombuffer(raw, np.uint8), encoder.mean)
    own = [0, *map(int, cuts), len(raw)]
    ids, decoded = encoder.encode([raw[a:b] for a, b in zip(own, own[1:], strict=False) if b > a])
    want = encoder.tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == encoder.tok.decode(want, skip_special_tokens=False)


def test_a_very_long_word_is_encoded_in_linear_time(encoder):
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFG0123456789+/", k=5_000_000))
    raw = text.encode()
    begin = time.perf_counter()
    cuts = [0, *map(int, bpe_chunks.cut_points(np.frombuffer(raw, np.uint8), encoder.mean)), len(raw)]
    ids, decoded = encoder.encode([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    took, begin = time.perf_counter() - begin, time.perf_counter()
    want = encoder.tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == encoder.tok.decode(want, skip_special_tokens=False)
    assert took < 3 * (time.perf_counter() - begin) + 5
    assert encoder.word_bytes < encoder.most_word_bytes and max(map(len, encoder.words), default=0) <= bpe_chunks.LONG


def test_encoding_odd_rows(odd):
    got = bpe_chunks.encode_documents(odd, word_bpe_path(), keep_ids=True)
    assert got.columns[:4] == ["doc_id", "lang", "source", "key"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[4].bp_n_tokens == 0 and rows[4].bp_decoded_sha256 == sha("") and rows[9].bp_n_tokens == 2
    assert bpe_chunks.encode_documents(odd.limit(0), word_bpe_path()).count() == 0


# --- clashing columns
def test_columns_with_the_names_of_results_are_replaced(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with_names = lambda *names: odd.select("*", *(F.lit("x").alias(n) for n in names))
    ran = [
        line_dedup.dedup_lines(with_names("ld_text", "LD_LINES", "key2")),
        quality_rules.judge(with_names("kept", "n_words", "features", "sm_id"), labels),
        cotraining.classify_quality(with_names("ct_score", "sm_id", "sm_label", "c0"), labels),
        toxicity.score_toxicity(with_names("tx_score", "sm_label", "c1"), labels),
        bpe_chunks.encode_documents(with_names("bp_n_tokens", "bp_text", "c0"), word_bpe_path()),
    ]
    for got in ran:
        names = [c.lower() for c in got.columns]
        assert len(set(names)) == len(names) and got.count() == 11
    assert ran[1].where("n_words = 0").count() == 3 and ran[4].where("bp_text = 'x'").count() == 11
    assert near_dedup.near_duplicates(with_names("copy", "node", "class_id")).count() == 11
    assert mixing.mix_to_targets(with_names("mx_size", "mx_id")).count() == 11
    assert suffix_dedup.dedup_substrings(with_names("n_bytes", "d")).count() == fingerprints.fingerprint_neighbours(with_names("fp_id")).count() == 11


# --- pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    out = corpus_pipeline.tokens(spark, docs, SF)
    assert out.count() == docs.count() > 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_counted_sets_hot_keys_apart_without_another_join(spark, how):
    from platewise.llm.columns import join_counted

    keys = [b"hot"] * 60 + [f"k{i}".encode() for i in range(40)] + [None]
    left = spark.createDataFrame([(k if k is None else bytearray(k), i) for i, k in enumerate(keys)], "key binary, i int")
    right = spark.createDataFrame([(bytearray(b"hot"), 60, 1)] + [(bytearray(f"k{i}".encode()), 1, 2) for i in range(0, 40, 2)], "key binary, n long, v int")
    got = join_counted(left, right, "key", "n", share=10, how=how)
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
    value = lambda k: 1 if k == b"hot" else 2 if k and int(k[1:]) % 2 == 0 else None
    assert {(r.i, r.v) for r in got.collect()} == {(i, value(k)) for i, k in enumerate(keys) if how == "left" or value(k)}
