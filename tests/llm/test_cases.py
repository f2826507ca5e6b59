"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from quernstone.llm import chat, decontaminate, exact_dedup, licenses, line_dedup, mixing, near_dedup, quality, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, id string, n string, digest string, keep_id string, size string, score double, held_out string"
LONG = " ".join(f"w{i % 997}x" for i in range(30000))
ROWS = [
    (1, "one two three four five six seven"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "one two three four five six seven"),
    (1, "one two three four five six seven"),
    (5, LONG),
    (6, "Ünï çödé 漢字 🙂 text\nsecond line of it"),
    (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None if k % 4 == 0 else f"s{k % 3}", 0, "x", "x", "x", "x", "x", "x", 0.5, "x") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "x"), (None, 1, 1, "x"), (3, None, None, "x"), (5, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(7, "two three four", "x"), (None, "five six", "x"), (8, None, "x"), (9, "", "x"), (7, "two three four", "x")], "item_id long, text string, doc_id string")


OPERATORS = {
    "line_dedup": lambda d, lab, it: line_dedup.dedup_lines(d),
    "decontaminate": lambda d, lab, it: decontaminate.contamination(d, it),
    "remove": lambda d, lab, it: decontaminate.remove_contamination(d, it),
    "mix": lambda d, lab, it: mixing.mix(d),
    "toxicity": lambda d, lab, it: toxicity.classify(d, lab),
    "near_dedup": lambda d, lab, it: near_dedup.near_duplicates(d),
    "quality": lambda d, lab, it: quality.classify(d, lab),
    "exact_dedup": lambda d, lab, it: exact_dedup.exact_groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, labels, items, name):
    got = [r.doc_id for r in OPERATORS[name](docs, labels, items).collect()]
    key = lambda x: (x is None, x)
    assert sorted(got, key=key) == sorted((i for i, _ in ROWS), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, items, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0), items.limit(0)).count() == 0
    assert OPERATORS[name](docs, labels.limit(0), items.limit(0)).count() == len(ROWS)


def test_operators_of_other_shapes_on_odd_rows(docs):
    assert licenses.scan_licenses(docs).count() == 0
    counts = token_counts.section_tokens(docs)
    assert counts.groupBy().agg(F.sum((F.col("n_tokens") < 0).cast("int"))).first()[0] == 0
    assert counts.where("section = 0").count() == len(ROWS)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert token_counts.section_tokens(docs.limit(0)).count() == 0


def test_defined_results_of_odd_rows(docs, labels, items):
    n = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect() if r.doc_id is not None}
    assert (n[2].n_shingles, n[3].n_shingles, n[4].n_shingles) == (0, 0, 0)
    assert n[3].component_id == 3 and n[4].component_id == 4
    e = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect() if r.doc_id is not None}
    assert e[1].group_size == 3 and e[1].kept and e[2].group_size == 3 and e[3].keep_id == 2 and not e[3].kept
    assert not e[4].kept or e[4].group_size == 1
    d = [r for r in decontaminate.contamination(docs, items).collect() if r.doc_id == 1]
    assert all(r["items"] == ["7"] and [tuple(s) for s in r.spans] == [(1, 4), (4, 6)] or [tuple(s) for s in r.spans] == [(1, 6)] for r in d)
    q = quality.classify(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in q] == [0.5]


def test_chat_on_odd_rows(spark):
    rows = [(1, 0, "user", "a", 9), (1, 0, "user", "a", 9), (1, 1, None, None, 9), (2, 0, "user", "a", 9), (None, 0, "user", "lost", 9), (3, None, "user", "a", 9), (4, 0, "user", "", 9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part long")
    got = {r.conv_id: r for r in chat.format_chats(table).collect()}
    # 2 is a prefix of 1; 3 says the same as 2.
    assert set(got) == {1, 4} and got[1].n_turns == 2
    assert got[1].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>\n<|im_end|>\n"
    assert chat.format_chats(table.limit(0)).count() == 0


def test_clashing_names_of_other_shapes(spark):
    chats = spark.createDataFrame([(1, 0, "user", "a", *["x"] * 6), (1, 1, "bot", None, *["x"] * 6)], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in ("n_turns", "snapshots", "part", "rendered", "_place", "_h1")))
    assert chat.format_chats(chats).first().n_turns == 2
    docs = spark.createDataFrame([(1, "All rights reserved.", *["x"] * 8)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in ("license", "start", "end", "matched", "coverage", "section", "n_tokens", "complete")))
    assert licenses.scan_licenses(docs).first().license == "all-rights-reserved"
    assert token_counts.section_tokens(docs).first().section == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_of_every_rule_add_up(spark, rule):
    texts = ["one\n\ntwo  three\n", "naïve\ncafé 漢字\n🙂🙂", "", "a\n" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {}
    for r in token_counts.section_tokens(docs, rule=rule).collect():
        by[r.doc_id] = by.get(r.doc_id, 0) + r.n_tokens
    with open(token_counts.VOCABULARY, "rb") as f:
        encoding, _ = token_counts.encoder(f.read(), token_counts.VOCABULARY)
    assert by == {i: pytest.approx(len(encoding.encode_ordinary(t))) for i, t in enumerate(texts)}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_fields_share_the_tokens_of_the_whole(spark, rule):
    rows = [(1, "web", "en", "naïve text\nof it"), (2, None, "de", "x"), (3, None, None, None), (4, "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = {}
    for r in token_counts.field_tokens(docs, rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.field] = (r.start, r.end, r.n_tokens)
    with open(token_counts.VOCABULARY, "rb") as f:
        encoding, _ = token_counts.encoder(f.read(), token_counts.VOCABULARY)
    whole = {1: "source: web\nlang: en\n\nnaïve text\nof it", 2: "\nlang: de\n\nx", 4: "source: \nlang: \n\n"}
    assert set(got) == {1, 2, 4} and set(got[2]) == {"lang", "text"}
    for i, text in whole.items():
        assert sum(n for _, _, n in got[i].values()) == pytest.approx(len(encoding.encode_ordinary(text)))
        assert max(e for _, e, _ in got[i].values()) == len(text)


def test_schedule_gives_the_words_that_are_taken(spark):
    docs = spark.createDataFrame([(i, "w " * (5 + i % 7), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    pieces = {}
    for r in mixing.mix_schedule(docs).collect():
        assert 0 <= r.from_word < r.to_word and 0 <= r.position < 1
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.to_word - r.from_word
    assert pieces == {i: t for i, t in taken.items() if t}
