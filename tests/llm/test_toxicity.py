import math
import zlib
from itertools import product

import numpy as np
import pytest

from quillspark.llm import queries, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_the_edit_distance():
    terms = {"abcab": 1.0, "babbabbab": 2.0, "bca": 3.0}
    machine = toxicity.Automaton(terms, {"cc": 4.0})
    for n in range(1, 8):
        for letters in product("abc", repeat=n):
            word = "".join(letters)
            exact, fuzzy, stem = machine.match(word)
            near = [w for t, w in terms.items() if 0 < distance(word, t) <= toxicity.edits_allowed(t)]
            assert exact == terms.get(word, 0.0) and fuzzy == (0.0 if exact else max(near, default=0.0)) and stem == (4.0 if word.startswith("cc") else 0.0)
    assert machine.match("babbcbbac")[1] == 2.0 and machine.match("babcccbab")[1] == 0.0


def test_quotation_and_abuse():
    s = toxicity.Scorer({"idiot": 1.0}, {}, [])
    names = ["hits", "stems", "quoted", "abuse", "best", "share"]
    said, meant = (dict(zip(names, s.features(t), strict=True)) for t in ('she said "idiot" is a word', "you are an idiot"))
    assert said["quoted"] > said["abuse"] == 0 and meant["abuse"] > meant["quoted"] == 0 and s.features("an idoit")[0] == 0 < s.features("an idiott")[0]


def test_held_out_accuracy(spark, sf_dir):
    larger = sf_dir.replace("0.001", "0.1")
    got = queries.op10_toxicity(spark, larger).join(queries.table(spark, larger, "labels"), "doc_id").where("held_out and toxic is not null").toPandas()
    assert (got.predicted[got.toxic == 1]).mean() >= 0.85 and (got.predicted[got.toxic == 0]).mean() <= 0.01
    assert got.score.between(0, 1).all()


def brute_scores(docs, labels):
    """Scores of all documents, with the lexicon counted and words compared one by one."""
    crc = lambda d, n: zlib.crc32(str(d).encode()) % n
    rows = [(docs[d] or "", t) for d, t in labels if d in docs and crc(d, 5)]
    n_toxic = sum(t for _, t in labels if crc(_, 5))
    n_clean = sum(1 - t for _, t in labels if crc(_, 5))
    counts = {}
    for text, toxic in rows:
        for g in toxicity.grams(text):
            counts.setdefault(g, [0, 0])[toxic] += 1
    lift = {g: round(math.log((b + 0.5) / (n_toxic + 1)) - math.log((a + 0.5) / (n_clean + 1)), 6) for g, (a, b) in counts.items() if b >= max(3, n_toxic // 200)}
    words = {g: x for g, x in lift.items() if x > math.log(8) and not g.endswith("*")}
    most = lambda stem: max([counts[w][1] for w in words if w.startswith(stem)], default=0)
    stems = {g[:-1]: x for g, x in lift.items() if x > math.log(8) and g.endswith("*") and counts[g][1] > 1.05 * most(g[:-1])}

    def near(word, allowed):
        return [(d, t) for t in words if 0 < allowed(t) and abs(len(t) - len(word)) <= 2 and 0 < (d := distance(word, t)) <= allowed(t)]

    misspelled = {}
    for g, (a, _) in counts.items():
        if a > 1 and not g.endswith("*") and g not in words and (found := near(g, toxicity.edits_allowed)):
            term = min(found)[1]
            misspelled[term] = misspelled.get(term, 0) + a
    strict = {t for t, n in misspelled.items() if n > max(1, n_clean // 1000)}

    def match(word):
        found = [0.0, 0.0, 0.0]
        for part in toxicity.WORD.findall(word):
            exact = words.get(part, 0.0)
            fuzzy = 0.0 if exact else max([words[t] for _, t in near(part, lambda t: 0 if t in strict else toxicity.edits_allowed(t))], default=0.0)
            found = list(map(max, found, (exact, fuzzy, max([x for s, x in stems.items() if part.startswith(s)], default=0.0))))
        return tuple(found)

    memo = {}

    def features(text):
        found, x = text.lower().split(), [0.0] * 6
        for i, w in enumerate(found):
            m = memo.setdefault(w, None) or memo.__setitem__(w, match(w)) or memo[w]
            if not any(m):
                continue
            bare = {v.strip(".,;:!?()" + toxicity.QUOTES) for v in found[max(0, i - 4) : i + 5]}
            x[0], x[1], x[5] = x[0] + (m[0] > 0) + 0.8 * (m[1] > 0), x[1] + (m[2] > 0), x[5] + sum(v > 0 for v in m)
            x[4] = max(x[4], *m)
            if w[0] in toxicity.QUOTES or w[-1] in toxicity.QUOTES or bare & toxicity.REPORTING:
                x[2] += max(m)
            elif bare & toxicity.ADDRESS:
                x[3] += max(m)
        return [math.log1p(v) for v in x[:4]] + [x[4], x[5] / math.sqrt(len(found) + 1)]

    x, y = np.array([features(t) for t, _ in rows]), np.array([t for _, t in rows])
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-3)
    # plain gradient steps to the same optimum
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    ridge = np.array([1e-6, *[1.0] * 6])
    told = minimize(lambda b: np.logaddexp(0, z @ b).sum() - y @ (z @ b) + 0.5 * (ridge * b * b).sum(), ridge)
    score = lambda t: 1 / (1 + math.exp(-float(np.array([1.0, *((np.array(features(t)) - mean) / sd)]) @ told)))
    return {d: score(t or "") for d, t in docs.items()}


def minimize(loss, at):
    """Coordinate by coordinate, by thirds of an interval; the losses here are convex."""
    at = at * 0.0
    for _ in range(60):
        for i in range(len(at)):
            low, high = at[i] - 4, at[i] + 4
            while high - low > 1e-7:
                a, b = low + (high - low) / 3, high - (high - low) / 3
                low, high = (low, b) if loss(np.where(np.arange(len(at)) == i, a, at)) < loss(np.where(np.arange(len(at)) == i, b, at)) else (a, high)
            at[i] = (low + high) / 2
    return at


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    labels = [(r.doc_id, int(r.toxic > 0)) for r in queries.table(spark, sf_dir, "labels").collect() if r.toxic is not None]
    want = brute_scores(docs, labels)
    got = queries.op10_toxicity(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-3) and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_memory_is_bounded(monkeypatch):
    """Forgetting words and states changes no score, and a giant word is not remembered."""
    terms = {"abcab": 1.0, "babbabbab": 2.0}
    texts = [" ".join("".join(w) for w in product("abc", repeat=k)) for k in range(1, 7)] + ["abcab " + "x" * 5000 + "abcab you"]
    want = [toxicity.Scorer(terms, {"cca": 3.0}, []).features(t) for t in texts]
    monkeypatch.setattr(toxicity, "WORDS_KEPT", 20)
    monkeypatch.setattr(toxicity, "STEPS_KEPT", 30)
    scorer = toxicity.Scorer(terms, {"cca": 3.0}, [])
    assert [scorer.features(t) for t in texts] == want and max(map(len, scorer.seen)) <= toxicity.WORD_BYTES


def test_awkward_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (4, 1, 0), (None, 0, 1), (6, None, None), (7, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, labels).toPandas()
    assert len(got) == 10 and got.score.between(0, 1).all() and got.predicted.isin([0, 1]).all()
    assert toxicity.scored(no_docs, labels).count() == 0 and toxicity.scored(docs, labels.limit(0)).where("predicted = 1").count() == 0
