import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import components, exact_dedup, line_dedup, near_dedup
from quernstone.llm.components import connected

WORDS = [a + b for a in ("ka", "lo", "mi", "ten", "ruf", "sab") for b in ("da", "ne", "pol", "x", "yy", "ogi", "ur")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        base = text(rng, rng.randint(20, 120)).split()
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += ["ka lo", "ka  LO", "mi"]
    return list(enumerate(texts))


def brute(rows, width):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_against_brute_force(spark, near, width):
    got = near_dedup.near_duplicates(spark.createDataFrame(near, "doc_id long, text string"), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(near, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_residual_blocks_find_what_rounds_leave(spark, near, monkeypatch):
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    # Wide buckets, so that many pairs of unlike documents share one.
    monkeypatch.setattr(near_dedup, "band_keys", lambda sig: np.where(np.arange(near_dedup.BANDS) < 3, sig[: near_dedup.BANDS] % 2, sig[: near_dedup.BANDS]).astype(np.int64) * 64 + np.arange(near_dedup.BANDS))
    got = near_dedup.near_duplicates(spark.createDataFrame(near, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(near, 4)


def test_pruning_keeps_similar_pairs():
    needed = near_dedup.least_matches(80)
    rng = np.random.default_rng(0)
    p = 0.8 + 0.2 / 256
    lost = 0
    for _ in range(2000):
        same = rng.random(near_dedup.HASHES) < p
        lost += any(same[:n].sum() < m for n, m in needed)
    assert lost <= 10
    assert needed[-1][0] == near_dedup.HASHES and needed[-1][1] > 0.6 * near_dedup.HASHES


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.concatenate((a[:800], np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - j) < 0.12


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert got == {x: find(x) for x in list(up)}


def exact_brute(rows):
    out, groups = {}, {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for ids in groups.values():
        for i in ids:
            out[i] = (min(ids), len(ids))
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: F.unhex(F.sha2(F.substring(t, 1, 2), 256)), lambda t: F.unhex(F.sha2(F.lit(""), 256))])
@pytest.mark.parametrize("memtable", [2, 1 << 17])
def test_exact_groups_even_when_digests_collide(spark, digest, memtable):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a b", "a  b", "a\tb", "ab", "a c", None, "", " ", "zz" * 50, "a b "])) for i in range(300)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), digest=digest, memtable_rows=memtable).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == exact_brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_compaction_keeps_the_smallest_id():
    rng = np.random.default_rng(2)
    d = rng.integers(0, 1 << 63, (500, 4)).astype(np.uint64)
    pick = rng.integers(0, 500, 5000)
    import pandas as pd

    runs = []
    for a in range(0, 5000, 700):
        batch = exact_dedup.flushed(d[pick[a : a + 700]], np.arange(a, min(5000, a + 700)), np.ones(len(pick[a : a + 700]), np.int64), 0)
        runs.append(batch.to_pandas())
    out = exact_dedup.compact_shard(pd.concat(runs))
    want = {}
    for i, p in enumerate(pick.tolist()):
        want.setdefault(p, []).append(i)
    assert sorted(zip(out["keep_id"], out["copies"])) == sorted((min(v), len(v)) for v in want.values())


def lines_brute(rows, split=line_dedup.parsed):
    """Every line against every template of its leaf, by tokens."""
    lines, groups = [], {}
    for i, t in rows:
        for pos, _, tokens in split((t or "").encode()):
            n, width = len(tokens), len(tokens) // 5
            shapes = {(n, -1, tuple(tokens), ())}
            if n >= 5:
                starts = [*range(3, n - width + 1, max(1, width // 2)), n - width]
                shapes |= {(n, a, tuple(tokens[:a]), tuple(tokens[a + width :])) for a in starts}
            lines.append((i, t, pos, shapes))
            for s in shapes:
                groups.setdefault(s, []).append((i, line_dedup.text_hash(t.encode()), t))
    recurring = {s: g for s, g in groups.items() if len({t for _, _, t in g}) > 1}
    dropped = set()
    for i, t, pos, shapes in lines:
        own = [s for s in shapes if s in recurring]
        if own:
            best = max(own, key=lambda s: (len(recurring[s]), -s[1]))
            if min(recurring[best])[2] != t:
                dropped.add((i, pos))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in dropped) if t is not None else None for i, t in rows}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    shared = [text(rng, 12) for _ in range(6)]
    rows = []
    for i in range(120):
        lines = [text(rng, rng.randint(1, 15)) for _ in range(4)]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(shared).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(3, 12)] = rng.choice([*WORDS, str(rng.randrange(99))])
            lines.insert(rng.randrange(4), " ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert {i: r.text for i, r in got.items()} == lines_brute(rows)
    assert sum(r.n_dropped for r in got.values()) > 20
    assert got[500].text == got[501].text == got[3].text


def test_variable_fields_are_generalised(spark):
    rows = [(i, f"Posted by user{i} on 2024-01-{i:02d} in the forum of the town\nkept {zlib.crc32(bytes([i]))}") for i in range(5)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_dropped for r in got] == [0, 1, 1, 1, 1]
    assert got[2].text.startswith("kept")


def test_lines_that_follow_no_common_template_stay(spark):
    # The third words of the first two have hashes whose lower 16 bits are equal.
    rows = [(1, "the quick brown wordqyo jumps high"), (2, "the quick brown wordtq jumps low"), (3, "Share this article\nown words of three"), (4, "Share this article\nother words of four")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1] and got[3] == rows[2][1] and got[4] == "other words of four"


def test_ids_must_be_numbers(spark):
    docs = spark.createDataFrame([("a", "x y")], "doc_id string, text string")
    for operator in (line_dedup.dedup_lines, near_dedup.near_duplicates, exact_dedup.exact_groups):
        with pytest.raises(TypeError, match="integer"):
            operator(docs)


def own_lines(t):
    """Position, key, tokens by the rules as stated, without the operator's splitting."""
    for pos, line in enumerate(t.decode().split("\n")):
        tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
        if len(tokens) >= 5:
            tokens = ["<*>" if re.search("[0-9]", x) else x for x in tokens]
        if tokens:
            yield pos, xxhash.xxh3_128_digest(" ".join(tokens).encode()), tokens


def test_line_dedup_of_short_lines_against_brute_force(spark):
    rng = random.Random(12)
    short = [text(rng, n) for n in (1, 1, 2, 3, 4, 4, 5, 5, 5)] + ["All rights reserved.", "版权所有。", "Version 2", "Version 3", "12"]
    rows = []
    for i in range(80):
        lines = [rng.choice(short) if rng.random() < 0.3 else text(rng, rng.randint(1, 9)) for _ in range(5)]
        lines[rng.randrange(5)] += rng.choice(["", "  ", "\t", "\n", "\n \t"])
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == lines_brute(rows, own_lines)
    for line in ("All rights reserved.", "版权所有。", "Version 2", "Version 3", "12"):
        assert sum(line in [x.strip() for x in t.split("\n")] for _, t in rows) > 1
        assert sum(line in [x.strip() for x in t.split("\n")] for t in got.values()) == 1
