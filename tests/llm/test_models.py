import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import chat, mixing, quality, token_counts, toxicity

DATA, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_factorisation_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = quality.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, quality.RANK)), np.zeros(14), np.ones(14))
    index, value = np.array([1, 5, 20, 33, 2, 7]), rng.normal(size=6)
    got, _ = model.raw(index, value, np.array([0, 4]))
    for row, a, b in ((0, 0, 4), (1, 4, 6)):
        want = 0.3 + sum(model.linear[i] * x for i, x in zip(index[a:b], value[a:b]))
        want += sum(model.factors[index[i]] @ model.factors[index[j]] * value[i] * value[j] for i in range(a, b) for j in range(i + 1, b))
        assert got[row] == pytest.approx(want)


def held_out(spark, scored, label, data=DATA):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    return [(r[0], r[1]) for r in rows]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = held_out(spark, quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")), "quality")
    assert np.mean([p == y for p, y in rows]) > 0.95
    assert np.mean([p for p, y in rows if y == 1]) > 0.99


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = toxicity.classify(docs, labels)
    rows = held_out(spark, scored, "toxic")
    assert np.mean([p for p, y in rows if y == 0]) < 0.02
    # Of the 14 toxic rows 4 are German, and only 2 German ones are in the training labels.
    assert np.mean([p for p, y in rows if y == 1]) > 0.6
    again = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in scored.collect())


@pytest.mark.skipif(not os.path.exists(LARGER), reason="no test tables")
def test_toxicity_on_more_labels(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    rows = held_out(spark, toxicity.classify(docs, spark.read.parquet(f"{LARGER}/labels.parquet")), "toxic", LARGER)
    assert np.mean([p for p, y in rows if y == 0]) < 0.02
    assert np.mean([p for p, y in rows if y == 1]) >= 0.9


def test_label_model_finds_accuracies_and_discounts_copies(spark):
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.2
    fires = lambda p1, p0: rng.random(4000) < np.where(y, p1, p0)
    good, fair = fires(0.8, 0.02), fires(0.6, 0.1)
    votes = np.stack([good, fair, fires(0.5, 0.05), good], axis=1)
    table = spark.createDataFrame([([int(k) for k in np.flatnonzero(v)],) for v in votes], "fired array<int>")
    model = toxicity.estimate(table, 4, (votes[:200].astype(float), y[:200].astype(int)))
    rate = lambda i: [model.rates[c, 0, i] for c in (0, 1)]
    assert rate(0)[1] == pytest.approx(0.8, abs=0.1) and rate(1)[0] == pytest.approx(0.1, abs=0.05)
    # The fourth voter repeats the first, so it depends on it, and its vote tells nothing more.
    assert model.parent.tolist() == [0, 1, 2, 0]
    once, twice = model.posterior(np.array([[1.0, 0, 0, 1]])), LabelModelOf(model, 3).posterior(np.array([[1.0, 0, 0]]))
    assert once == pytest.approx(twice, abs=0.05)


def LabelModelOf(model, m):
    """The first m voters of a model."""
    return toxicity.LabelModel(model.prior, model.parent[:m], model.rates[:, :, :m])


def test_posterior_is_the_likelihood_written_out():
    rng = np.random.default_rng(5)
    m = 5
    model = toxicity.LabelModel(0.3, np.array([0, 0, 1, 1, 4]), rng.uniform(0.05, 0.95, (2, 2, m)))
    for _ in range(20):
        v = (rng.random(m) < 0.5).astype(float)
        like = []
        for c, prior in ((0, 0.7), (1, 0.3)):
            p = prior
            for i in range(m):
                up = int(v[model.parent[i]]) if model.parent[i] != i else 0
                r = model.rates[c, up, i]
                p *= r if v[i] else 1 - r
            like.append(p)
        assert model.posterior(v[None, :])[0] == pytest.approx(like[1] / sum(like))


def test_training_rows_are_bounded(spark):
    from quernstone.llm import labelled

    docs = spark.range(2000).selectExpr("id % 40 AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    got = labelled.training_rows(docs, labels, "toxic", 4, 2, rows=10).collect()
    assert 0 < len(got) <= 10 and len({r._id for r in got}) == len(got)
    every = labelled.texts_of(docs, "doc_id", "text")
    few = labelled.bounded(every, 30, size=60).collect()
    assert 0 < len(few) < 30 and sum(len(r.text) for r in few) <= 60



def test_token_spans_tile_the_text_and_rules_agree():
    with open(token_counts.VOCABULARY, "rb") as f:
        encoding, lengths = token_counts.encoder(f.read(), "test")
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice(["a", "the ", "\n", "\n\n", " ", "é", "漢", "🙂", "12", "!?"]) for _ in range(rng.randint(1, 60)))
        starts, ends = token_counts.token_spans(text, encoding, lengths)
        assert starts[0] == 0 and ends[-1] == len(text) and (ends >= starts).all()
        at = token_counts.line_sections(text)
        lines = text.split("\n")
        assert len(at) == len(lines) - (lines[-1] == "")
        totals = {rule: token_counts.allocate(starts, ends, at, len(text), rule) for rule in token_counts.RULES}
        assert all(t.sum() == pytest.approx(len(starts)) for t in totals.values())
        bounds = np.append(at, len(text))
        for rule, pick in (("first", starts), ("last", ends - 1)):
            want = [sum(a <= p < b for p in pick) for a, b in zip(bounds, bounds[1:])]
            assert totals[rule].tolist() == want


def test_boundary_tokens_by_rule():
    starts, ends, sections = np.array([0, 3, 9]), np.array([3, 9, 12]), np.array([0, 5])
    assert token_counts.allocate(starts, ends, sections, 12, "first").tolist() == [2, 1]
    assert token_counts.allocate(starts, ends, sections, 12, "last").tolist() == [1, 2]
    assert token_counts.allocate(starts, ends, sections, 12, "majority").tolist() == [1, 2]
    assert token_counts.allocate(starts, ends, sections, 12, "split") == pytest.approx([1 + 2 / 6, 1 + 4 / 6])


def waterfill(sizes, total=1.5, repeats=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, total * sum(sizes.values()), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > repeats * sizes[s]}
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = repeats * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "a", "b", "c", None, "d"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    sources = {}
    for i, _, s in rows:
        sources[s] = sources.get(s, 0) + size[i]
    want, of = waterfill(sources), {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and r.target == pytest.approx(want[of[r.doc_id]])
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 5 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_small_sources_meet_their_targets_beside_large_ones(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 64)
    rng = random.Random(8)
    sizes = {f"big{k}": 60000 for k in range(3)} | {f"small{k}": rng.choice([3, 40, 150, 700, 2500]) for k in range(30)}
    rows = [(k * 1000 + d, "w " * (n // 10 if d else n - n // 10 * 9), s) for k, (s, n) in enumerate(sizes.items()) for d in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, of = waterfill(sizes), {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in mixing.mix(docs).collect():
        assert 0 <= r.taken <= 2 * r["size"]
        taken[of[r.doc_id]] += r.taken
    small = [s for s in sizes if s.startswith("small")]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 4 for s in small)
    assert abs(sum(taken[s] - want[s] for s in small)) <= 0.01 * sum(want[s] for s in small)
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] for s in sizes if s not in small)


def test_schedule_is_low_discrepancy(spark):
    sources = spark.createDataFrame([("a", 0, 500, 500.0), ("b", 1, 300, 300.0), ("c", 2, 200, 200.0)], "source string, source_no int, source_size long, target double")
    rows = mixing.schedule(sources, 1000).orderBy("slot").collect()
    seen = {0: 0, 1: 0, 2: 0}
    for n, r in enumerate(rows, 1):
        assert r.block == seen[r.source_no]
        seen[r.source_no] += 1
        assert all(abs(seen[k] - n * w) < 6 for k, w in ((0, 0.5), (1, 0.3), (2, 0.2)))


def test_collapse_against_brute_force(spark):
    rng = random.Random(7)
    convs = []
    for _ in range(60):
        base = [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randint(1, 6))]
        convs.append(base)
        convs += [base[: rng.randint(1, len(base))] for _ in range(rng.randint(0, 2))]
    rows = [(c, k, r, t) for c, turns in enumerate(convs) for k, (r, t) in enumerate(turns)]
    got = {r.conv_id: r.rendered for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    keep = {i for i, a in enumerate(convs) if not any(len(b) > len(a) and b[: len(a)] == a for b in convs) and not any(b == a for b in convs[:i])}
    assert set(got) == keep
    assert all(got[i] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in convs[i]) for i in keep)


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 4)
    rows = [(1, k, "user", str(k)) for k in range(10)] + [(2, k, "user", str(k)) for k in range(9)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("part").collect()
    assert [(r.conv_id, r.part, r.n_turns) for r in got] == [(1, 0, 10), (1, 1, 10), (1, 2, 10)]
    assert F is not None
