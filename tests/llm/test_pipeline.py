import os
import random

import pytest
from test_dedup import brute as near_brute
from test_dedup import lines_brute
from test_search import brute as windows_brute

import corpus_pipeline
from quernstone.llm import decontaminate, quality

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_stages_feed_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "mixture":
            assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    before, after = seen["quality_filter"]
    scored = quality.classify(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert after.count() == scored.where("predicted = 1").count() < before.count()
    _, cleaned = seen["decontamination"]
    assert decontaminate.contamination(cleaned, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("size(spans) > 0").count() == 0
    before, mixed = seen["mixture"]
    assert mixed.count() == before.count()
    assert {r.doc_id: r.text for r in mixed.collect()} == {r.doc_id: r.text for r in before.collect()}


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "line_dedup", "near_dedup", "decontamination", "mixture"]


ALPHABET = [a + b for a in ("ka", "lo", "mi", "ten", "ruf", "sab", "dor") for b in ("da", "ne", "pol", "x", "yy", "ogi", "ur", "est")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Prose and junk with shared lines, near copies and benchmark passages; labels of quality for some."""
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("small")
    prose = lambda n: " ".join(rng.choice(ALPHABET) for _ in range(n))
    passages, shared = [prose(25) for _ in range(4)], [prose(9) for _ in range(3)]
    rows = []
    for i in range(90):
        if i % 4 == 3:
            rows.append((i, "\n".join(f"#{rng.randint(0, 9)}$ {'|' * rng.randint(1, 5)} @@" for _ in range(12)), f"s{i % 3}"))
            continue
        lines = [prose(rng.randint(8, 20)) for _ in range(3)]
        lines += [rng.choice(shared)] * (rng.random() < 0.4) + [prose(4) + " " + rng.choice(passages) + " " + prose(4)] * (rng.random() < 0.3)
        rows.append((i, "\n".join(lines), f"s{i % 3}"))
        if rng.random() < 0.2:
            words = rows[-1][1].split(" ")
            words[rng.randrange(len(words))] = rng.choice(ALPHABET)
            rows.append((200 + i, " ".join(words), "s1"))
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(k, t) for k, t in enumerate(passages)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    labels = [(i, int("@@" not in t), 0) for i, t, _ in rows if rng.random() < 0.8]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), passages


def test_chain_against_brute_force(spark, small):
    folder, passages = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_filter"](spark, docs, folder)
    kept = texts(good)
    assert kept == {i: t for i, t in texts(docs).items() if "@@" not in t}
    lines = stages["line_dedup"](spark, good, folder)
    want = {i: t for i, t in lines_brute(sorted(kept.items())).items() if t.split()}
    assert texts(lines) == want and want != kept
    near = stages["near_dedup"](spark, lines, folder)
    want_near = {i: want[i] for i, (_, c) in near_brute(sorted(want.items()), 5).items() if c == i}
    assert texts(near) == want_near and len(want_near) < len(want)
    clean = stages["decontamination"](spark, near, folder)
    got = texts(clean)
    hit = lambda d: {i: h for i, (_, h, _) in windows_brute(sorted(d.items()), list(enumerate(passages)), decontaminate.WINDOW).items()}
    before = hit(want_near)
    assert got.keys() == want_near.keys() and any(before.values()) and not any(hit(got).values())
    assert all(got[i] == want_near[i] for i, h in before.items() if not h)
    mixed = stages["mixture"](spark, clean, folder).collect()
    assert {r.doc_id: r.text for r in mixed} == got and all(r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size for r in mixed)
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        assert own[0].source_size == sum(r.size for r in own) and abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 2
    assert {r.doc_id: (r.text, r.taken) for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id: (r.text, r.taken) for r in mixed}


ODD = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "quite other words are in this row here"), (None, "one two three four five six"), (None, None), (2, None), (3, ""), (4, " \t "), (5, "w " * 30000)]
CLASHING = ("size", "taken", "target", "source_size", "score", "held_out", "predicted", "n_lines", "n_dropped", "_row", "_kept", "_hash", "_cut", "_id", "_text")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_empty_tables(spark, small, name):
    folder, _ = small
    rows = [(i, t, "en", None if k % 3 else "s", 0, *["x"] * len(CLASHING)) for k, (i, t) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, folder)
    got = [(r.doc_id, r.text) for r in out.collect()]
    if name == "mixture":
        assert [c for c in out.columns if c not in corpus_pipeline.MIX_COLUMNS] == [c for c in docs.columns if c not in corpus_pipeline.MIX_COLUMNS]
    else:
        assert out.columns == docs.columns and all(r.score == "x" and r._row == "x" for r in out.collect())
    if name in ("line_dedup", "decontamination", "mixture"):
        assert sorted(map(repr, got)) == sorted(map(repr, ODD))
    if name == "near_dedup":
        # Of the three equal rows one of id 1 stays; other words of the same id, and rows without words, stay.
        assert sorted(map(repr, got)) == sorted(map(repr, [ODD[0], ODD[2], *ODD[4:]]))
    assert stage(spark, docs.limit(0), folder).count() == 0
