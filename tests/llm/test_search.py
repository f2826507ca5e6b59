import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import decontaminate, licenses
from quernstone.llm.decontaminate import FMIndex, contamination, cut, remove_contamination, suffix_array

VOCABULARY = "alpha beta gamma delta eps zeta eta theta".split()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(1, 9))
def test_index_counts_and_locates(sequence, sample):
    index = FMIndex(np.array(sequence), sample)
    assert suffix_array(np.array([*sequence, 0])).tolist() == sorted(range(len(sequence) + 1), key=lambda i: [*sequence, 0][i:])
    for length in (1, 2, 4):
        phrases = np.array([[(p >> (2 * k)) % 5 + 1 for k in range(length)] for p in range(30)])
        for p, lo, hi in zip(phrases.tolist(), *index.search(phrases)):
            want = [i for i in range(len(sequence) - length + 1) if sequence[i : i + length] == p]
            assert sorted(index.locate(np.arange(lo, max(lo, hi))).tolist()) == want


def brute(docs, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for i, it in items:
            v = split(it)
            k = min(window, len(v))
            wins = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if k else set()
            for a in range(len(w) - k + 1):
                if k and tuple(w[a : a + k]) in wins:
                    hit |= set(range(a, a + k))
                    found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def tables(spark, seed=4):
    rng = random.Random(seed)
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(VOCABULARY).upper() if rng.random() < 0.2 else rng.choice(VOCABULARY) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 8, 14]) if i else 5)) for i in range(12)]
    items = [(i, t) for i, t in items if len(t.split()) != 1]
    docs = [(i, text(rng.randint(0, 40)) + (" " + rng.choice(items)[1] if rng.random() < 0.5 else "")) for i in range(80)]
    return docs, items


def measured(df):
    return {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in df.collect()}


def test_contamination_against_brute_force(spark, monkeypatch):
    docs, items = tables(spark)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 5)
    assert measured(contamination(d, b, window=5)) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    monkeypatch.setattr(decontaminate, "SHARD_SYMBOLS", 50)
    assert len(list(decontaminate.blocks_of(((str(i), t.encode()) for i, t in items), 5))) >= 3
    assert measured(contamination(d.repartition(3), b, window=5)) == want
    cleaned = remove_contamination(d, b, window=5)
    assert not any(hit for _, hit, _ in brute([tuple(r) for r in cleaned.collect()], items, 5).values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=6), st.lists(st.text("ab ", max_size=40), max_size=4), st.integers(1, 4), st.integers(1, 60))
def test_blocks_of_any_size_find_the_same(items, texts, window, size):
    rows = [(str(i), t.encode()) for i, t in enumerate(items)]
    want = brute(list(enumerate(texts)), list(enumerate(items)), window)
    covered, names = {i: set() for i in want}, {i: set() for i in want}
    for block in decontaminate.blocks_of(rows, window, size):
        phrases = decontaminate.Phrases(block, window)
        hits = decontaminate.hits_in([t.encode() for t in texts], phrases, 3)
        for d, s, e in hits.spans.tolist():
            covered[d] |= set(range(s, e))
        for d, k in hits.items.tolist():
            names[d].add(phrases.names[k])
    assert {i: (len(covered[i]), sorted(names[i])) for i in want} == {i: w[1:] for i, w in want.items()}


def test_removal_leaves_nothing(spark):
    docs, items = tables(spark, 8)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    cleaned = remove_contamination(d, b, window=5)
    assert all(r.spans == [] for r in contamination(cleaned, b, window=5).collect())
    clean = {i for i, (_, hit, _) in brute(docs, items, 5).items() if not hit}
    assert {r.doc_id: r.text for r in cleaned.collect() if r.doc_id in clean} == {i: t for i, t in docs if i in clean}


def test_cut_takes_what_stands_between():
    assert cut("One, two; three four.", [(1, 3)]) == "One,  four."


def test_license_spans_and_coverage(spark):
    from quernstone.llm.license_templates import TEMPLATES

    mit, apache = TEMPLATES["mit"], TEMPLATES["apache-2.0-line"]
    words = mit.split()
    edited = " ".join(w for k, w in enumerate(words) if k % 17)  # about 94 % of the words
    half = " ".join(words[: len(words) // 2])
    rows = [(1, f"Some text. {mit}\nmore"), (2, f"pre {edited} post"), (3, half), (4, f"x y\n{apache}"), (5, "Released the under License MIT"), (6, f"{apache} and later {apache}")]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {1, 2, 4, 6} and len(got[6]) == 2
    assert got[1][0].license == "mit" and got[1][0].coverage == 1.0
    assert rows[0][1][got[1][0].start : got[1][0].end] == mit.rstrip(".")
    assert got[2][0].license == "mit" and 0.9 < got[2][0].coverage < 1
    assert got[4][0].license == "apache-2.0-line"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = max(prev[j] + (x == y), prev[j + 1], row[j])
    return row[-1]


def test_banded_alignment_equals_full_alignment_in_a_wide_band():
    rng = random.Random(2)
    for _ in range(100):
        a = [rng.randint(1, 5) for _ in range(rng.randint(3, 15))]
        b = [rng.randint(1, 5) for _ in range(rng.randint(3, 15))]
        matched, start, end = licenses.aligned(np.array(a), np.array(b), -len(a), len(a) + len(b) + 1)
        assert matched == lcs(a, b)
        assert not matched or lcs(a, b[start:end]) == matched


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    span = licenses.GRAM + licenses.WINDOW - 1
    for _ in range(200):
        shared = rng.integers(1, 50, span)
        prints = [set(h[licenses.winnowed(h)].tolist()) for h in (licenses.gram_hashes(np.concatenate((rng.integers(1, 50, 7), shared, rng.integers(1, 50, 5)))) for _ in range(2))]
        assert prints[0] & prints[1]


def test_short_notices_are_found_whatever_word_is_changed():
    from quernstone.llm.license_templates import TEMPLATES

    scan = lambda t: [(m.license, m.matched, m.start, m.end) for m in licenses.Index().scan(licenses.words(t.encode()))]
    assert scan("(c) someone. All rights reserved.") == [("all-rights-reserved", 3, 2, 5)]
    assert scan("All rights reserved. All rights are reserved.") == [("all-rights-reserved", 3, 0, 3), ("all-rights-reserved", 3, 3, 7)]
    assert scan("Reserved: all seats. Some rights") == []
    for name in ("mit-notice", "apache-2.0-line", "gpl-3.0-line", "cc-by-nc-4.0-line", "cc-by-4.0"):
        w = [x.decode() for x in licenses.words(TEMPLATES[name].encode())]
        for k in range(len(w)):
            changed = ["foo", "bar", *w[:k], "xyz", *w[k + 1 :], "baz"]
            assert (name, len(w) - 1) in [m[:2] for m in scan(" ".join(changed))]
        spaced = " ".join(x + (" xyz" if 0 < k < 4 else "") for k, x in enumerate(w))
        assert (name, len(w)) in [m[:2] for m in scan(spaced)]


def test_cut_off_licences_are_reported_by_the_query(spark, tmp_path):
    from quernstone.llm import queries
    from quernstone.llm.license_templates import TEMPLATES

    mit, notice = TEMPLATES["mit"], TEMPLATES["mit-notice"]
    words = mit.split()
    half = " ".join(words[: len(words) // 2])
    rows = [(1, f"pre {half}"), (2, " ".join(words[-80:])), (3, mit), (4, "nothing of it"), (5, f"{half}\n{notice}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.license): r for r in queries.op2_license_scan(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, "mit"), (2, "mit"), (3, "mit"), (5, "mit"), (5, "mit-notice")}
    assert 0.4 < got[1, "mit"].coverage < 0.6 and not got[1, "mit"].complete
    assert rows[0][1][got[1, "mit"].start : got[1, "mit"].end] == half
    assert not got[2, "mit"].complete and got[3, "mit"].complete and got[5, "mit-notice"].complete and not got[5, "mit"].complete


def test_recall_against_full_alignment():
    """Edited licences in random texts: what a full alignment covers by 80 % is found, and other texts give nothing."""
    from quernstone.llm.license_templates import TEMPLATES

    rng = random.Random(6)
    names = ["mit", "isc", "bsd-2-clause", "apache-2.0", "gpl-notice", "mpl-2.0", "zlib", "unlicense", "bsd-disclaimer", "bsd-3-clause-text"]
    filler = lambda n: [rng.choice("ab cd ef the of and software license copyright to this in".split()) + rng.choice(["", "x", "y"]) for _ in range(n)]
    index, wanted, found = licenses.Index(), 0, 0
    for k in range(60):
        name = names[k % len(names)]
        template = [w.decode() for w in licenses.words(TEMPLATES[name].encode())]
        edited = []
        for w in template:
            r = rng.random()
            edited += [] if r < 0.04 else [w, "xyz"] if r < 0.08 else ["zyx"] if r < 0.12 else [w]
        before = rng.randint(0, 40)
        text = filler(before) + edited + filler(rng.randint(0, 40))
        if lcs(template, text) >= licenses.COVERAGE * len(template):
            wanted += 1
            got = [m for m in index.scan([w.encode() for w in text]) if m.license == name and m.coverage >= licenses.COVERAGE]
            found += any(m.start < before + len(edited) and m.end > before for m in got)
        assert not [m for m in index.scan([w.encode() for w in filler(200)]) if m.coverage >= licenses.COVERAGE and len(index.ids[index.names.index(m.license)]) > licenses.NOTICE]
    assert wanted > 50 and found >= 0.9 * wanted


def test_whole_licences_are_found(spark):
    from quernstone.llm.license_templates import TEMPLATES

    gpl, mpl = TEMPLATES["gpl-3-text"], TEMPLATES["mpl-2.0-text"]
    rows = [(1, f"readme\n{gpl}"), (2, mpl[: len(mpl) // 2]), (3, "the terms and conditions of this license apply to the work as a whole")]
    got = {}
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), least=licenses.PARTIAL).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.complete))
    assert got[1] == [("gpl-3-text", True)] and ("mpl-2.0-text", False) in got[2] and 3 not in got
