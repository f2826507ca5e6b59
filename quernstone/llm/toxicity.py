"""Toxicity by weak supervision.

Voters are words and word beginnings that mark labelled toxic rows, a general lexicon of insults, and patterns of shouting. A
generative model is estimated by EM over the votes on all documents: each voter fires with one rate in toxic and with another
in clean texts, and these rates depend on whether the voter fires that it is most correlated with (a tree of pairs), so votes
that repeat each other do not count twice. A linear classifier is then trained on the model's posterior labels of a sample of
all documents, labelled or not.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import written
from quernstone.llm.labelled import SAMPLE_ROWS, STATS, bounded, structure, texts_of, training_rows
from quernstone.llm.quality import score
from quernstone.llm.words import ALNUM, NONSPACE, slices, words

MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Least log-likelihood ratio of a voter's term in labels, and of a term of the classifier in posterior labels.
VOTER_G2, TERM_G2 = 12.0, 14.0
#: Byte lengths of word beginnings; a character is never cut.
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
EM_PASSES = 5
#: Share of toxic rows among those that a voter's term marks.
PRECISE = 0.8
#: Voters that a labelled toxic row shall have, as far as there are terms.
COVER = 8
#: A general lexicon (fixed values).
LEXICON = tuple("arschloch asshole bastard bitch clown connard crétin cretin disgusting dumbass dummkopf estúpido idiot idiota idiote imbécil imbécile imbecile loser moron pathetic scum stupid trash trottel worthless".split())


def parts(tokens: set[bytes]) -> set[bytes]:
    """Words and beginnings of words, the latter ending in '*'."""
    out = set(tokens)
    for w in tokens:
        for k in PREFIXES:
            if len(w) > k and w[k] & 0xC0 != 0x80:
                out.add(w[:k] + b"*")
    return out


def patterns(text: bytes | None) -> list[bool]:
    stats = dict(zip(STATS, structure(text, words(text, NONSPACE))))
    return [stats["upper"] > 0.3, stats["shouts"] > 0.05, stats["marked_words"] > 0.3]


N_PATTERNS = 3


def likelihood_ratio(a, b, n0: int, n1: int):
    """G2 of a term in a of n0 clean and b of n1 toxic rows; negative if it marks clean ones."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    p = (a + b) / max(1, n0 + n1)
    term = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(e, 1e-12)), 0)
    g = 2 * (term(a, n0 * p) + term(b, n1 * p) + term(n0 - a, n0 * (1 - p)) + term(n1 - b, n1 * (1 - p)))
    return np.where(b * n0 >= a * n1, g, -g)


@dataclass
class Terms:
    """Looks up which terms a text has."""

    terms: list[bytes]
    exact: dict = field(default_factory=dict)
    starts: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k, t in enumerate(self.terms):
            (self.starts if t.endswith(b"*") else self.exact)[t.rstrip(b"*")] = k

    def of(self, tokens: set[bytes]) -> set[int]:
        found = {self.exact[w] for w in tokens & self.exact.keys()}
        lengths = sorted({len(s) for s in self.starts})
        for w in tokens if lengths else ():
            for k in lengths:
                if len(w) > k and (n := self.starts.get(w[:k])) is not None:
                    found.add(n)
        return found


def marking(rows: list[tuple[float, bytes]], least_g2: float) -> tuple[list[bytes], Counter, Counter]:
    """Terms that mark toxic rows by least_g2 at least, the strongest first, and all terms' counts in clean and toxic rows.

    rows: posterior or label, and distinct words joined by spaces. Only terms of toxic rows can mark them; those are counted
    first, and clean rows then count what is left of them, so no more is held.
    """
    n = [sum(1 for y, _ in rows if (y > 0.5) == k) for k in (False, True)]
    by = (Counter(), Counter())
    for y, tokens in rows:
        if y > 0.5:
            by[1].update(parts(set(tokens.split())))
    least = next((b for b in range(1, n[1] + 1) if likelihood_ratio(0, b, *n) >= least_g2), n[1] + 1)
    by = (by[0], Counter({t: k for t, k in by[1].items() if k >= least}))
    for y, tokens in rows:
        if y <= 0.5:
            by[0].update(parts(set(tokens.split())) & by[1].keys())
    names = sorted(by[1])
    g = likelihood_ratio([by[0][t] for t in names], [by[1][t] for t in names], *n) if names else np.zeros(0)
    order = sorted(np.flatnonzero(g >= least_g2), key=lambda k: (-g[k], names[k]))
    return [names[k] for k in order], *by


def mine(rows: list[tuple[int, bytes]]) -> list[bytes]:
    """Voters' terms from labels and distinct words (joined by spaces), then the general lexicon.

    Voters cover every toxic row they can: each step takes the term that marks most rows which fewer than COVER voters mark, so
    that a language with few toxic rows gets voters of its own. There are at most COVER voters a toxic row.
    """
    strong, clean, toxic_counts = marking(rows, VOTER_G2)
    marked: dict[bytes, list[int]] = {t: [] for t in strong if toxic_counts[t] >= PRECISE * (clean[t] + toxic_counts[t])}
    toxic = [tokens for y, tokens in rows if y > 0.5]
    for i, tokens in enumerate(toxic):
        for t in parts(set(tokens.split())) & marked.keys():
            marked[t].append(i)
    need, voters = np.full(len(toxic), COVER), []
    while marked:
        best = max(marked, key=lambda t: (int((need[marked[t]] > 0).sum()), len(marked[t]), t))
        if not (need[marked[best]] > 0).any():
            break
        own = set(marked.pop(best))
        need[list(own)] -= 1
        voters.append(best)
        # Terms that mark nearly the same rows would only repeat its votes; so would those that no open row has.
        marked = {t: r for t, r in marked.items() if (need[r] > 0).any() and len(own.intersection(r)) < 0.9 * len(own.union(r))}
    return voters + [w for w in map(str.encode, LEXICON) if w not in voters]


@dataclass
class LabelModel:
    """prior: share of toxic rows; parent: the voter that a voter depends on (itself: none); rates[y, p, i]: how often voter i
    fires in class y when its parent does not (p = 0) and does (p = 1)."""

    prior: float
    parent: np.ndarray
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rates[1] / self.rates[0])
        off = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        above = votes[:, self.parent]
        above[:, self.parent == np.arange(len(self.parent))] = 0
        # log-odds of every voter's vote, given its parent's
        logit = np.log(self.prior / (1 - self.prior)) + off[0].sum()
        logit = logit + votes @ (on[0] - off[0]) + above @ (off[1] - off[0]) + (votes * above) @ (on[1] - off[1] - on[0] + off[0])
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def dense(fired: list[list[int]], m: int) -> np.ndarray:
    out = np.zeros((len(fired), m))
    for i, f in enumerate(fired):
        out[i, f] = 1
    return out


#: Rows of votes that a task looks at together.
VOTE_ROWS = 2048


def sums_of(votes: np.ndarray, p: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Of either class: rows, votes of each voter, of its parent, and of both, weighted by the posterior p."""
    above = votes[:, parent]
    out = []
    for w in (1 - p, p):
        out += [[w.sum()], w @ votes, w @ above, w @ (votes * above)]
    return np.concatenate(out)


def fitted(sums: np.ndarray, parent: np.ndarray, general: np.ndarray) -> LabelModel:
    """The model of weighted counts, drawn towards the general rates by the weight of 10 rows."""
    m = len(parent)
    by = sums.reshape(2, 1 + 3 * m)
    n, fired, above, both = by[:, :1], by[:, 1 : m + 1], by[:, m + 1 : 2 * m + 1], by[:, 2 * m + 1 :]
    own = parent == np.arange(m)
    alone = (fired + 10 * general) / (n + 10)
    # A rate given the parent's vote is drawn towards the rate without it.
    given = np.stack([(np.where(own, fired, fired - both) + 10 * alone) / (np.where(own, n, n - above) + 10), (both + 10 * alone) / (above + 10)], axis=1)
    return LabelModel(float((n[1, 0] + 1) / (n.sum() + 10)), parent, np.clip(given, 1e-6, 1 - 1e-6))


def estimate(votes: DataFrame, m: int, labelled: tuple[np.ndarray, np.ndarray]) -> LabelModel:
    """EM over all rows of votes(fired array<int>); a pass sends 2 + 6 m numbers per task.

    labelled: votes and labels of rows that keep their label; they start the estimate and stay in it. First the tree of pairs is
    found: a voter's parent is the earlier one with which its votes have most mutual information within the classes, from counts
    of the pairs that fire together.
    """
    v, y = labelled
    general = np.array([[0.002], [0.05]])
    truth = (y > 0).astype(float)

    def summed(model: LabelModel) -> np.ndarray:
        shared = pickle.dumps(model)

        def run(batches):
            own, total = pickle.loads(shared), np.zeros(2 + 6 * m)
            for batch in batches:
                for a in range(0, batch.num_rows, VOTE_ROWS):
                    x = dense(batch.column(0).slice(a, VOTE_ROWS).to_pylist(), m)
                    total += sums_of(x, own.posterior(x), own.parent)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "s"])

        sums = np.zeros(2 + 6 * m)
        for k, s in votes.mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s")).collect():
            sums[k] = s
        return sums

    alone = np.arange(m)
    model = fitted(sums_of(v, truth, alone), alone, general)
    parent = tree(pairs(votes, model), summed(model), m)
    known = sums_of(v, truth, parent)
    model = fitted(known, parent, general)
    for _ in range(EM_PASSES):
        model = fitted(summed(model) + known, parent, general)
    return model


def pairs(votes: DataFrame, model: LabelModel) -> list[tuple[int, int, float, float]]:
    """Voters i < j that fire together, and the weight of such rows in either class."""
    shared, m = pickle.dumps(model), len(model.parent)

    def run(batches):
        own, both = pickle.loads(shared), {}
        for batch in batches:
            for a in range(0, batch.num_rows, VOTE_ROWS):
                fired = batch.column(0).slice(a, VOTE_ROWS).to_pylist()
                for f, p in zip(fired, own.posterior(dense(fired, m)).tolist()):
                    f = sorted(f)
                    for b in range(1, len(f)):
                        for c in f[:b]:
                            e = both.setdefault((c, f[b]), [0.0, 0.0])
                            e[0] += 1 - p
                            e[1] += p
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in both], pa.int32()), pa.array([k[1] for k in both], pa.int32()), *(pa.array([e[c] for e in both.values()], pa.float64()) for c in (0, 1))], ["i", "j", "s0", "s1"])

    return [tuple(r) for r in votes.mapInArrow(run, "i int, j int, s0 double, s1 double").groupBy("i", "j").agg(F.sum("s0"), F.sum("s1")).collect()]


def tree(pairs: list[tuple[int, int, float, float]], sums: np.ndarray, m: int) -> np.ndarray:
    """Each voter's parent among the earlier ones: that of most mutual information within the classes, if positively related."""
    by = sums.reshape(2, 1 + 3 * m)
    total = by[:, 0].sum()
    parent, best = np.arange(m), np.full(m, 0.001)
    for i, j, *both in sorted(pairs):
        info, lift = 0.0, 0.0
        for c in (0, 1):
            n, a, b, ab = by[c, 0], by[c, 1 + i], by[c, 1 + j], both[c]
            if n <= 0:
                continue
            lift += ab - a * b / n
            for joint, row, column in ((ab, a, b), (a - ab, a, n - b), (b - ab, n - a, b), (n - a - b + ab, n - a, n - b)):
                if joint > 1e-9 and row > 1e-9 and column > 1e-9:
                    info += joint / total * np.log(joint * n / (row * column))
        if lift > 0 and info > best[j]:
            parent[j], best[j] = i, info
    return parent


@dataclass
class LinearClassifier:
    terms: Terms
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        raw = np.array([sum(self.weights[k] for k in self.terms.of(set(words(t, ALNUM)))) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.bias + raw, -35, 35)))


def sparse(rows: list[set[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of the ones, and the number of rows."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([k for r in rows for k in sorted(r)], np.int64), len(rows)


def raw_scores(x: tuple[np.ndarray, np.ndarray, int], weights: np.ndarray) -> np.ndarray:
    return np.bincount(x[0], weights[x[1]], x[2])


def fit_linear(x: tuple[np.ndarray, np.ndarray, int], target: np.ndarray, size: int, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full AdaGrad steps; both classes weigh the same in sum, up to tenfold."""
    share = np.clip(target.mean() if len(target) else 0.5, 1 / 11, 10 / 11)
    weight = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
    w, b = np.zeros(size), 0.0
    gw, gb = np.full(size, 1e-8), 1e-8
    for _ in range(steps if len(target) else 0):
        e = (1 / (1 + np.exp(-np.clip(raw_scores(x, w) + b, -35, 35))) - target) * weight / len(target)
        dw, db = np.bincount(x[1], e[x[0]], size) + decay * w, e.sum()
        gw, gb = gw + dw**2, gb + db**2
        w, b = w - rate * dw / np.sqrt(gw), b - rate * db / np.sqrt(gb)
    return w, float(b)


def best_cut(raw: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the gap between raw scores where rows above it agree best with truth, by F1."""
    order = np.argsort(-raw, kind="stable")
    raw, hits = raw[order], np.cumsum(truth[order] > 0)
    f1 = 2 * hits / (np.arange(1, len(raw) + 1) + hits[-1])
    last = np.append(raw[1:] != raw[:-1], True)  # equal scores fall on one side
    k = int(np.where(last, f1, -1).argmax())
    return float((raw[k] + raw[k + 1]) / 2) if k + 1 < len(raw) else float(raw[k] - 1)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= 0.3).

    Voters come from at most `rows` labelled rows that are not held out; the label model is estimated from the votes on all
    rows; the classifier is trained on its posterior labels of at most `rows` of all documents and of the labelled ones, which
    keep their label (both samples: ``labelled.bounded``). Only the text enters a score. Null and empty texts have no term and
    get the score of the bias. Without labels the general lexicon alone decides.
    """
    sample = training_rows(docs, labels, label_col, MODULUS, HELD_OUT, id_col, text_col, rows)
    every = bounded(texts_of(docs.where(F.col(id_col).isNotNull()), id_col, text_col), rows)

    def extract(batches):
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(2), pa.array([b" ".join(sorted(set(words(t)))) for t in texts], pa.binary()), pa.array([patterns(t) for t in texts], pa.list_(pa.bool_()))],
                ["id", "y", "tokens", "patterns"],
            )

    both = sample.unionByName(every.join(sample.select("_id"), "_id", "left_anti").withColumn("y", F.lit(-1)))
    held = both.mapInArrow(extract, "id string, y int, tokens binary, patterns array<boolean>").toLocalIterator()
    got = sorted(((r[0], min(1, int(r[1])), bytes(r[2]), r[3]) for r in held), key=lambda r: r[:2])
    truth = np.array([y for _, y, _, _ in got], int)
    voters = mine([(y, tokens) for _, y, tokens, _ in got if y >= 0])
    lookup, m = Terms(voters), len(voters) + N_PATTERNS

    def fires(tokens: set[bytes], fired: list[bool]) -> list[int]:
        return sorted(lookup.of(tokens)) + [len(voters) + k for k, on in enumerate(fired) if on]

    def vote(batches):
        for batch in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([fires(set(words(t)), patterns(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["fired"])

    votes = written(docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(vote, "fired array<int>"), "votes")
    own = dense([fires(set(tokens.split()), fired) for _, _, tokens, fired in got], m)
    model = estimate(votes, m, (own[truth >= 0], truth[truth >= 0]))

    posterior = np.where(truth < 0, model.posterior(own), truth)
    terms, _, _ = marking([(p, tokens) for p, (_, _, tokens, _) in zip(posterior, got)], TERM_G2)
    if not terms:
        table = Terms([w.encode() for w in LEXICON])
        return score(docs, LinearClassifier(table, np.full(len(LEXICON), 3.0), -3.0), id_col, text_col, MODULUS, HELD_OUT, THRESHOLD)
    table = Terms(list(dict.fromkeys([*terms, *voters])))
    x = sparse([table.of(set(tokens.split())) for _, _, tokens, _ in got])
    weights, bias = fit_linear(x, posterior, len(table.terms))
    bias += np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(raw_scores(x, weights) + bias, posterior > 0.5)
    return score(docs, LinearClassifier(table, weights, bias), id_col, text_col, MODULUS, HELD_OUT, THRESHOLD)
