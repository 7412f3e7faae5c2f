"""Toxicity by a weighted finite-state grammar over clauses.

The insult transducer is a trie over letters, learnt from labels: it reads a word and writes its class, an insult of
one of LEVELS weights among them. Four transducers over word classes follow, each a table of (state, class) -> (next
state, class written, weights): negation and reported speech open scopes in which insults and threats become negated
or reported ones; a threat counts only with a target after it; an insult near a target counts as a targeted one as
well. Their composition is one table, which runs through a clause. What matched clauses weigh, never words by
themselves, makes the features of a logistic regression, in which plain, targeted and threat masses can only raise a
score, negated and reported ones only lower it.

Training counts beginnings of words in the texts of at most MOST_TOXIC and MOST_CLEAN labelled ids, chosen by a hash
of the id; executors count and take the features, no text reaches the driver. Weights are estimated on one half of
the sample when the other half's features are taken, so that the regression does not trust chance. Scoring reads every
whole text. Only text is an input of a score.

Defined results: a null text is an empty text; texts without a matched clause all get the same low score up to
their length; without labels of both kinds every score is 0. Equal texts get equal scores. Documents that share an id
count once in the sample, those without an id not at all.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, kept_by_worker, stored
from .tokenization import blocks

MOST_TOXIC, MOST_CLEAN = 2000, 3000
#: Beginnings of words that are tried, the least number of toxic texts, of the log odds, and of the likelihood ratio.
BEGINNINGS, LEAST_TEXTS, LEAST_ODDS, LEAST_RATIO = (4, 5, 6, 7, 8), 3, 1.2, 18.0
#: Words that a scope of negation and the nearness of a target hold; what a worker keeps of the insult transducer's answers.
SCOPE, NEAR, KEEP_WORDS = 4, 3, 200_000
#: The words of the four fixed transducers (English, German, French, Spanish).
THREAT = frozenset("kill killing hurt destroy stab shoot beat burn murder töten umbringen erschießen tuer frapper matar golpear".split())
TARGET = frozenset("you your yourself he she they him her his their du dich dir ihr euch sie er tu toi vous ils elles usted ustedes ellos ellas".split())
NEGATION = frozenset("not never don't isn't aren't doesn't neither nor nicht kein keine niemals jamais aucun nunca tampoco".split())
REPORTED = frozenset("said says say quote quoted called wrote claimed sagte schrieb nannte dit écrit dijo escribió llamó".split())
_LETTERS = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;\n]+")
#: What may be attached to a word.
_MARKS = ".,:\"'()[]*#$%&-"

#: Weights of the levels of insults (log odds), and the bounds between them.
LEVELS, BETWEEN = (1.8, 3.5, 5.5), (2.5, 4.5)
INSULT = tuple(f"insult{i}" for i in range(len(LEVELS)))
#: The classes that words have, and those that transducers write besides.
WORDS = ("other", "negation", "reported", "target", "threat", *INSULT)
SCOPED = tuple(f"{how} {x}" for how in ("negated", "reported") for x in ("threat", *INSULT))
CLASSES = (*WORDS, *SCOPED)
MASSES = ("plain", "negated", "reported", "targeted", "threat")
_NUMBER = {c: i for i, c in enumerate(CLASSES)}
_OTHER, _FIRST_INSULT = _NUMBER["other"], _NUMBER[INSULT[0]]
FEATURES = 9
#: Signs that coefficients may have (0: any), and what they are where the sample says nothing; see `Reader.features`.
SIGNS = (0, 0, 1, -1, -1, 1, 1, 1, 1)
PRIOR = (0.0, 0.0, 2.0, -0.5, -0.5, 0.5, 2.0, 0.5, 0.5)


@dataclass
class Transducer:
    """A sequential weighted transducer as tables by state and class; the start is state 0."""

    next: np.ndarray  # (states, classes) -> state
    written: np.ndarray  # (states, classes) -> class
    weight: np.ndarray  # (states, classes, masses)

    @classmethod
    def of(cls, start, step) -> Transducer:
        """The tables of the states that step(state, class) -> (state, class written, {mass: weight}) reaches from start."""
        number, queue, rows = {start: 0}, [start], []
        for state in queue:
            for c in CLASSES:
                to, out, masses = step(state, c)
                if to not in number:
                    number[to] = len(queue)
                    queue.append(to)
                rows.append((number[to], _NUMBER[out], [masses.get(m, 0.0) for m in MASSES]))
        shape = (len(queue), len(CLASSES))
        return cls(np.array([r[0] for r in rows], np.int32).reshape(shape), np.array([r[1] for r in rows], np.int8).reshape(shape), np.array([r[2] for r in rows]).reshape(*shape, len(MASSES)))

    def then(self, other: Transducer) -> Transducer:
        """The composition: what `other` does with what this one writes; only the reachable pairs of states."""
        pairs, number = [(0, 0)], {(0, 0): 0}
        for a, b in pairs:
            for c in range(len(CLASSES)):
                to = int(self.next[a, c]), int(other.next[b, self.written[a, c]])
                if to not in number:
                    number[to] = len(pairs)
                    pairs.append(to)
        a, b = np.array(pairs).T
        middle = self.written[a]
        to = zip(self.next[a].ravel().tolist(), other.next[b[:, None], middle].ravel().tolist(), strict=True)
        following = np.array([number[p] for p in to], np.int32).reshape(middle.shape)
        return Transducer(following, other.written[b[:, None], middle], self.weight[a] + other.weight[b[:, None], middle])

    def run(self, classes: Iterable[int]) -> tuple[list[int], np.ndarray]:
        """What is written for a clause, and its masses."""
        state, out, total = 0, [], np.zeros(len(MASSES))
        for c in classes:
            out.append(int(self.written[state, c]))
            total += self.weight[state, c]
            state = int(self.next[state, c])
        return out, total


def negation() -> Transducer:
    """After a negation, insults and threats of the next SCOPE words are negated."""

    def step(left: int, c: str):
        if c == "negation":
            return SCOPE, "other", {}
        return max(left - 1, 0), f"negated {c}" if left and (c == "threat" or c in INSULT) else c, {}

    return Transducer.of(0, step)


def reported_speech() -> Transducer:
    """After a verb of saying, insults and threats of the rest of the clause are reported."""

    def step(open_: bool, c: str):
        if c == "reported":
            return True, "other", {}
        return open_, f"reported {c}" if open_ and (c == "threat" or c in INSULT) else c, {}

    return Transducer.of(False, step)


def threat() -> Transducer:
    """A threat weighs one if a target comes within NEAR words; threats before the same target count each."""

    def step(waiting: tuple[bool, ...], c: str):
        later = (*waiting[1:], c == "threat")
        if c == "target":
            return (False,) * NEAR, c, {"threat": float(sum(waiting))}
        return later, "other" if c == "threat" else c, {}

    return Transducer.of((False,) * NEAR, step)


def target() -> Transducer:
    """An insult within NEAR words of a target, before or after it, is targeted as well."""

    def step(state: tuple[int, tuple[int, ...]], c: str):
        aim, waiting = state
        if c == "target":
            return (NEAR, (-1,) * NEAR), c, {"targeted": float(sum(LEVELS[x] for x in waiting if x >= 0))}
        level = INSULT.index(c) if c in INSULT else -1
        masses = {"targeted": LEVELS[level]} if level >= 0 and aim else {}
        return (max(aim - 1, 0), (*waiting[1:], -1 if aim else level)), c, masses

    return Transducer.of((0, (-1,) * NEAR), step)


def weigher() -> Transducer:
    """The last transducer: what an insult weighs as a plain, negated or reported one."""

    def step(_: int, c: str):
        how, _, what = c.rpartition(" ")
        return 0, c, {how or "plain": LEVELS[INSULT.index(what)]} if what in INSULT else {}

    return Transducer.of(0, step)


def parts() -> list[Transducer]:
    """The transducers over classes in the order of their composition."""
    return [negation(), reported_speech(), threat(), target(), weigher()]


@functools.cache
def grammar() -> Transducer:
    """Their composition."""
    return functools.reduce(Transducer.then, parts())


class Insults(dict):
    """The insult transducer's answers, by raw word: the class that the trie of learnt beginnings and the fixed words give."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.trie: dict = {}
        for beginning, w in weights.items():
            node = self.trie
            for letter in beginning:
                node = node.setdefault(letter, {})
            node[""] = w

    def weight(self, word: str) -> float:
        """The greatest weight that the trie writes on the way through a word and its end."""
        best, node = 0.0, self.trie
        for letter in word + "$":
            node = node.get(letter)
            if node is None:
                break
            best = max(best, node.get("", 0.0))
        return best

    def __missing__(self, raw: str) -> int:
        w = raw.strip(_MARKS)
        fixed = next((c for c, words in (("negation", NEGATION), ("reported", REPORTED), ("target", TARGET), ("threat", THREAT)) if w in words), None)
        if fixed:
            out = _NUMBER[fixed]
        else:
            best = max(map(self.weight, _LETTERS.findall(raw)), default=0.0)
            out = _FIRST_INSULT + sum(best >= x for x in BETWEEN) if best else _OTHER
        if len(self) >= KEEP_WORDS:
            self.clear()
        self[raw] = out
        return out


class Reader:
    """Features of texts by the composed grammar, with plain tables for the walk."""

    _HITS = frozenset(_NUMBER[c] for c in ("threat", *INSULT))

    def __init__(self, weights: dict[str, float]) -> None:
        self.classes = Insults(weights)
        g = grammar()
        self.next, self.weight = g.next.tolist(), [[w if any(w) else None for w in row] for row in g.weight.tolist()]

    def masses(self, words: list[str]) -> list[float]:
        """The masses of one clause."""
        state, total, classes = 0, [0.0] * len(MASSES), self.classes
        for raw in words:
            c = classes[raw]
            w = self.weight[state][c]
            if w is not None:
                total = [a + b for a, b in zip(total, w, strict=True)]
            state = self.next[state][c]
        return total

    def features(self, text: str) -> list[float]:
        """One, the length, the five masses of all matched clauses, the heaviest clause, and the number of matched clauses."""
        lower = text.lower()
        words = lower.split()
        size = math.log1p(len(words))
        if self._HITS.isdisjoint(map(self.classes.__getitem__, words)):
            return [1.0, size] + [0.0] * (FEATURES - 2)
        total, clauses, heaviest = [0.0] * len(MASSES), 0, 0.0
        for clause in _CLAUSE.split(lower):
            own = clause.split()
            if not self._HITS.isdisjoint(map(self.classes.__getitem__, own)):
                masses = self.masses(own)
                weight = masses[0] + masses[3] + masses[4]
                clauses += weight > 0
                heaviest = max(heaviest, weight)
                total = [a + b for a, b in zip(total, masses, strict=True)]
        return [1.0, size, *map(math.log1p, total), math.log1p(heaviest), math.log1p(clauses)]


def beginnings(text: str) -> set[str]:
    """The beginnings of the words of a text, and whole words (ending in $)."""
    own = set(_LETTERS.findall(text.lower()))
    return {w[:k] for w in own for k in BEGINNINGS if len(w) >= k} | {w + "$" for w in own if len(w) > 2}


def weights_of(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log odds of the beginnings that toxic texts have more often, given their numbers of toxic and clean texts."""
    out = {}
    for w, a, b in counts:
        if a < LEAST_TEXTS or not toxic or not clean:
            continue
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        rate = (a + b) / (toxic + clean)
        ratio = 2 * (a * math.log(a / (rate * toxic)) + (b * math.log(b / (rate * clean)) if b else 0.0))
        if odds >= LEAST_ODDS and ratio >= LEAST_RATIO:
            out[w] = odds
    return out


@dataclass
class Model:
    """Weights of the insult transducer and of the regression over the features."""

    weights: dict[str, float] = field(default_factory=dict)
    beta: np.ndarray | None = None

    def score(self, texts: list[str], reader: Reader | None = None) -> np.ndarray:
        if self.beta is None or not texts:
            return np.zeros(len(texts))
        reader = reader or Reader(self.weights)
        x = np.array([reader.features(t) for t in texts])
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...] = SIGNS, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method with a small ridge towards PRIOR; features whose coefficient has the wrong sign are left out."""
    used = np.arange(x.shape[1])
    while True:
        own, prior = x[:, used], np.array(PRIOR)[used]
        beta = np.zeros(len(used))
        for _ in range(steps):
            p = 1.0 / (1.0 + np.exp(-np.clip(own @ beta, -30, 30)))
            step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + ridge * np.eye(len(used)), own.T @ (y - p) - ridge * (beta - prior))
            beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        wrong = beta * np.array(signs)[used] < 0
        if not wrong.any():
            out = np.zeros(x.shape[1])
            out[used] = beta
            return out
        wrong &= np.abs(beta) == np.abs(beta[wrong]).max()
        used = used[~wrong]


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, toxic, half, n: in how many texts of a task each beginning is; an empty one counts the texts themselves."""
    kept_by_worker("toxicity")
    for batch in batches:
        for rows, texts in blocks(batch, 2):
            seen: Counter = Counter()
            for toxic, half, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), texts, strict=True):
                seen.update((w, toxic, half) for w in beginnings(text))
                seen[("", toxic, half)] += 1
            if seen:
                w, toxic, half = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(toxic, pa.int32()), pa.array(half, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["w", "toxic", "half", "n"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from doc_id and text of docs, and doc_id and toxic of labels."""
    chosen = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("toxic").cast("int").alias("toxic"), F.col("doc_id").alias("doc_id"))
    chosen = bounded_sample(chosen, "toxic", "doc_id", F.when(F.col("__v") == 1, MOST_TOXIC).otherwise(MOST_CLEAN))
    # At most MOST_TOXIC + MOST_CLEAN ids: broadcast, so that texts of others are not moved.
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("text")).join(F.broadcast(chosen), F.col("__id") == F.col("doc_id"))
    texts = texts.groupBy("toxic", "doc_id").agg(F.min("text").alias("text"))
    sample = stored(texts.select("toxic", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"), "text"), "labelled")
    seen = sample.mapInArrow(_beginnings, "w string, toxic int, half int, n long")
    count = lambda toxic, half: F.sum(F.when((F.col("toxic") == toxic) & (F.col("half") == half), F.col("n")).otherwise(0)).alias(f"n{toxic}{half}")
    table = stored(seen.groupBy("w").agg(*[count(t, h) for t in (0, 1) for h in (0, 1)]).filter(F.col("n10") + F.col("n11") >= LEAST_TEXTS), "beginnings")
    sizes = table.filter("w = ''").first()
    if sizes is None or not (sizes.n00 + sizes.n01):
        return Model()
    # Those that are less frequent in toxic texts than a multiple of clean ones are in no model; few remain.
    toxic, clean = sizes.n10 + sizes.n11, sizes.n00 + sizes.n01
    likely = F.greatest(*[(F.col(f"n1{h}") + 0.5) / (F.col(f"n0{h}") + 0.5) for h in (0, 1)]) >= 0.5 * toxic / clean
    rows = table.filter((F.col("w") != "") & likely).collect()
    halves = [weights_of(((r.w, r[f"n1{h}"], r[f"n0{h}"]) for r in rows), sizes[f"n1{h}"], sizes[f"n0{h}"]) for h in (0, 1)]
    weights = weights_of(((r.w, r.n10 + r.n11, r.n00 + r.n01) for r in rows), toxic, clean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("toxicity")
        readers = [Reader(halves[1]), Reader(halves[0])]
        for batch in batches:
            for part, texts in blocks(batch, 2):
                x = [readers[h].features(t) for h, t in zip(part.column(1).to_pylist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    found = sorted((tuple(r.x), r.toxic) for r in sample.mapInArrow(run, "toxic int, x array<double>").collect())
    return Model(weights, regression(np.array([x for x, _ in found]), np.array([y for _, y in found], float)))


def score(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of df named in keep (default: doc_id) with the toxicity score of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = [doc_id] if keep is None else keep
    names = [f"__k{i}" for i in range(len(keep))]
    rows = df.select(F.col(text).alias("__text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = rows.select(*names).schema.add("toxicity", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("toxicity")
        own = shared.value
        reader = Reader(own.weights)
        for batch in batches:
            for part, texts in blocks(batch, 0):
                yield pa.RecordBatch.from_arrays([*(part.column(i + 1) for i in range(len(names))), pa.array(own.score(texts, reader))], names=[f.name for f in schema])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "toxicity")
