"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, with context-window scores.

Learning: from a bounded sample of labelled documents (`sample`, by hash of their ids), words and word stems that
occur in toxic documents far more often than in others form the lexicon, all that pass the thresholds. Terms of five or
more letters may be misspelled: the automaton that accepts everything within one edit of a term (two from nine
letters on) runs on the trie. Both are one lazily built deterministic automaton, whose states are sets of (trie
node, edits left); a stem accepts every word that begins with it. A match inside quotation marks, or close to a
reporting word, counts for quotation, one near a word of address for abuse. A logistic model over these few
sums turns them into a score; it is fitted on the same bounded sample.

Null and empty texts score by the model's intercept. Texts may be of any length and are scored whole. Ties in the lexicon
go by term. Repeated rows score alike. Labels that are null are not used; a label twice for one document, as a label of a
repeated doc_id, counts twice. Without any label of either kind, every score is the share of toxic labels (0 if there are
none); no documents give no rows. Other columns, whatever their names, are ignored, or kept as they are in `row`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, map_rows

SAMPLE, STEMS = 10_000, (3, 4, 5, 6)
WORD = re.compile(r"[^\W_]+(?:['’@$!][^\W_]+)*")
QUOTES = "\"“”«»„"
REPORTING = frozenset("said says called word term quote quoted wrote phrase says meaning insult slur dit mot terme sagte wort begriff dijo palabra".split())
ADDRESS = frozenset("you your you're youre u ur are such these those du dich dein ihr euch tu te toi vous ton eres usted ustedes".split())
#: Words whose matches a worker remembers, and steps of the automaton that it keeps; both start over when they are full.
WINDOW, FEATURES, WORDS_KEPT, WORD_BYTES, STEPS_KEPT = 4, 6, 600_000, 80, 250_000


class Model(NamedTuple):
    terms: dict[str, float]  # whole words, with their weights
    stems: dict[str, float]
    strict: list[str]  # terms that are met as they are only
    beta: list[float]
    mean: list[float]
    sd: list[float]


class Automaton:
    """All terms' Levenshtein automata on their trie, as one automaton that is made as words need it."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], strict: tuple[str, ...] | list[str] = ()):
        self.edits = {t: 0 if t in set(strict) else edits_allowed(t) for t in terms}
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, float] | None] = [None]
        self.stem: list[float] = [0.0]
        self.room: list[int] = [0]  # edits that some term below the node allows
        for kind, words in ((0, terms), (1, stems)):
            for term, weight in sorted(words.items()):
                at = 0
                allowed = 0 if kind else self.edits[term]
                for c in term:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.ends.append(None)
                        self.stem.append(0.0)
                        self.room.append(0)
                    at = self.next[at][c]
                    self.room[at] = max(self.room[at], allowed)
                if kind:
                    self.stem[at] = max(self.stem[at], weight)
                else:
                    self.ends[at] = (term, weight)
        self.room[0] = max([0, *self.room])
        self.forget()

    def forget(self) -> None:
        """Start over with the states made so far; they are made again as words need them."""
        self.steps = 0
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.accept: list[tuple[float, float]] = []
        self.start = self.state({(0, 0)})

    def state(self, pairs: set[tuple[int, int]]) -> int:
        """The state of (node, edits made) pairs, closed under letters left out of the word."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, made = todo.pop()
            if (made and made > self.room[node]) or best.get(node, 99) <= made:
                continue
            best[node] = made
            todo += [(child, made + 1) for child in self.next[node].values()]
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            exact = max([self.ends[n][1] for n, made in best.items() if self.ends[n] and made == 0], default=0.0)
            fuzzy = max([self.ends[n][1] for n, made in best.items() if self.ends[n] and 0 < made <= self.edits[self.ends[n][0]]], default=0.0)
            self.accept.append((exact, 0.0 if exact else fuzzy))
        return self.ids[key]

    def move(self, at: int, c: str) -> int:
        pairs: set[tuple[int, int]] = set()
        for node, made in self.sets[at]:
            if (child := self.next[node].get(c)) is not None:
                pairs.add((child, made))
            pairs.add((node, made + 1))  # a letter too many
            pairs.update((other, made + 1) for other in self.next[node].values())  # another letter
        to = self.step[at][c] = self.state(pairs)
        self.steps += 1
        return to

    def begin(self) -> int:
        if self.steps > STEPS_KEPT:
            self.forget()
        return self.start

    def near(self, word: str) -> str | None:
        """The term that a word misspells, if there is one and the word is not itself a term."""
        at = self.begin()
        for c in word:
            to = self.step[at].get(c)
            at = self.move(at, c) if to is None else to
            if not self.sets[at]:
                return None
        if not self.accept[at][1]:
            return None
        return min((made, self.ends[n][0]) for n, made in self.sets[at] if self.ends[n] and 0 < made <= self.edits[self.ends[n][0]])[1]

    def match(self, word: str) -> tuple[float, float, float]:
        """Weights of the best exact, misspelled and stem matches of a word."""
        at, node, stem = self.begin(), 0, 0.0
        for c in word:
            if node is not None and (node := self.next[node].get(c)) is not None:
                stem = max(stem, self.stem[node])
            to = self.step[at].get(c)
            at = self.move(at, c) if to is None else to
            if node is None and not self.sets[at]:
                return 0.0, 0.0, stem
        return (*self.accept[at], stem)


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Scorer:
    """Features of texts; matches of words seen before are remembered."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], strict: list[str]):
        self.automaton = Automaton(terms, stems, strict)
        self.seen: set[str] = set()
        self.matched: dict[str, tuple[float, float, float]] = {}

    def features(self, text: str) -> list[float]:
        words = text.lower().split()
        distinct = set(words)
        if len(self.seen) > WORDS_KEPT:
            self.seen, self.matched = set(), {}
        new = distinct - self.seen
        for word in new:
            found = (0.0, 0.0, 0.0)
            for part in WORD.findall(word):
                found = tuple(map(max, found, self.automaton.match(part)))
            if any(found):
                self.matched[word] = found
        here = self.matched.keys() & distinct
        hits = [(i, self.matched[w]) for i, w in enumerate(words) if w in here] if here else []
        if any(len(w) > WORD_BYTES for w in new):  # not worth remembering
            for word in [w for w in new if len(w) > WORD_BYTES]:
                self.matched.pop(word, None)
                new.discard(word)
        self.seen |= new
        exact = fuzzy = stem = quoted = abuse = 0.0
        for i, m in hits:
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            weight = max(m)
            exact, fuzzy, stem = exact + (m[0] > 0), fuzzy + (m[1] > 0), stem + (m[2] > 0)
            bare = {w.strip(".,;:!?()" + QUOTES) for w in near}
            if words[i][0] in QUOTES or words[i][-1] in QUOTES or not REPORTING.isdisjoint(bare):
                quoted += weight
            elif not ADDRESS.isdisjoint(bare):
                abuse += weight
        return [math.log1p(exact + 0.8 * fuzzy), math.log1p(stem), math.log1p(quoted), math.log1p(abuse), max([max(m) for _, m in hits], default=0.0), (exact + fuzzy + stem) / math.sqrt(len(words) + 1)]


def logistic(beta: list[float], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.asarray(beta[1:]) + beta[0], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton's method with a ridge on all but the intercept."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    beta, penalty = np.zeros(x1.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


def grams(text: str) -> set[str]:
    """Words of a text as they are, and their stems with a star."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def lexicon_of(found: list[tuple[str, int, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems of (term, toxic documents, lift), best first.

    A stem stays if it has more documents than any one word that it begins, so that it stands for a family.
    """
    words = {t: (n, x) for t, n, x in found if not t.endswith("*")}
    most = lambda stem: max([n for w, (n, _) in words.items() if w.startswith(stem)], default=0)
    return {w: x for w, (_, x) in words.items()}, {t[:-1]: x for t, n, x in found if t.endswith("*") and n > 1.05 * most(t[:-1])}


def constant(n_toxic: int, n: int) -> Model:
    """The share of toxic labels for every text."""
    share = min(max(n_toxic / max(1, n), 1e-6), 1 - 1e-6)
    return Model({}, {}, [], [math.log(share / (1 - share)), *[0.0] * FEATURES], [0.0] * FEATURES, [1.0] * FEATURES)


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, folds: int = 5) -> Model:
    """Fit on the `sample` labelled documents outside fold 0 whose ids hash lowest.

    Only their ids and labels (at most `sample` rows) are broadcast; their texts are read where they lie. What
    reaches the driver is bounded too: the lexicon, whose terms each stand in some sampled documents, and FEATURES numbers for each sampled document.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != 0))
    chosen = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = [(r.doc_id, int(r.toxic > 0)) for r in chosen.collect()]
    n_toxic = sum(t for _, t in rows)
    n_clean = len(rows) - n_toxic
    if not n_toxic or not n_clean:
        return constant(n_toxic, len(rows))
    small = spark.createDataFrame(rows, "doc_id long, toxic int")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(small), "doc_id")

    def count(batch: Iterator[tuple]) -> Iterator[tuple]:
        seen: dict[str, list[int]] = {}
        for _, text, toxic in batch:
            for g in grams(text or ""):
                seen.setdefault(g, [0, 0])[toxic] += 1
            if len(seen) > 1_000_000:
                yield from ((g, a, b) for g, (a, b) in seen.items())
                seen = {}
        yield from ((g, a, b) for g, (a, b) in seen.items())

    counted = map_rows(held, count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    least = max(3, n_toxic // 200)
    best = counted.where(F.col("toxic") >= least).withColumn("lift", lift).where(F.col("lift") > math.log(8)).orderBy(F.desc(F.col("lift") * F.sqrt("toxic")), "term").collect()
    terms, stems = lexicon_of([(r.term, r.toxic, round(r.lift, 6)) for r in best])

    loose = Automaton(terms, {})

    def misspelled(batch: Iterator[tuple]) -> Iterator[tuple]:
        for word, clean in batch:
            if (term := loose.near(word)) is not None:
                yield term, clean

    # a term may be met misspelled unless that happens in clean documents too
    near = map_rows(counted.where((F.col("clean") > 1) & ~F.col("term").endswith("*")).select("term", "clean"), misspelled, "term string, clean long").groupBy("term").agg(F.sum("clean").alias("clean"))
    strict = [r.term for r in near.where(F.col("clean") > max(1, n_clean // 1000)).collect()]

    def describe(batch: Iterator[tuple]) -> Iterator[tuple]:
        scorer = Scorer(terms, stems, strict)
        for doc_id, text, toxic in batch:
            yield doc_id, toxic, scorer.features(text or "")

    fitted = map_rows(held, describe, "doc_id long, toxic int, x array<double>").collect()
    if not fitted:
        return constant(n_toxic, len(rows))
    fitted.sort(key=lambda r: (r.doc_id, r.toxic, r.x))
    x, y = np.array([r.x for r in fitted]), np.array([r.toxic for r in fitted])
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-3)
    return Model(terms, stems, strict, fit_logistic((x - mean) / sd, y), mean.tolist(), sd.tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text: a narrow job."""
    scorer = scorer_of(model)

    def run(batch: Iterator[tuple]) -> Iterator[tuple]:
        p = scorer()
        for doc_id, text in batch:
            yield doc_id, p(text or "")

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def scored_rows(docs: DataFrame, model: Model) -> DataFrame:
    """Every row, all its columns in `row`, with its score: a narrow job."""
    scorer, at, schema = scorer_of(model), docs.columns.index("text"), ", ".join(f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = scorer()
        for batch in batches:
            scores = pa.array([p(text or "") for text in batch.column(at).to_pylist()], pa.float64())
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays([row, scores], names=["row", "score"])

    return map_batches(docs, run, f"row struct<{schema}>, score double")


def scorer_of(model: Model) -> Callable[[], Callable[[str], float]]:
    """What makes, in a worker, a function of texts to scores."""

    def make() -> Callable[[str], float]:
        scorer, mean, sd, beta = Scorer(model.terms, model.stems, model.strict), np.array(model.mean), np.array(model.sd), model.beta
        return lambda text: float(logistic(beta, (np.array([scorer.features(text)]) - mean) / sd)[0])

    return make


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
