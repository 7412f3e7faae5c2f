"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to three bytes over the case-folded UTF-8 text. A byte that a context
has seen costs -log2(count / (total + distinct)) bits there; another one costs the escape,
-log2(distinct / (total + distinct)), and is looked for in the next shorter context, at last in the uniform
one over 256 bytes; a context that a language has never seen is passed over without a cost. Statistics are
frozen after training and kept as sorted tables, one for each language and order, so memory follows what was seen.
The exact code length (in double precision) of every distinct run of four bytes of a block of texts is found once
for each language and summed over the texts. A text goes to the language with the shortest code.

Training reads the whole texts of at most SAMPLE_PER_LANGUAGE labelled ids a language, chosen by a hash of the
id; the counts are taken by the executors, and only counts reach the driver. Every label is learnt, however many
there are. Scoring reads every whole text. Defined results: null texts and texts without a letter are `und` with
score 0, as is every text where there is nothing to learn from; equal texts get equal results; ties go to the
first language in alphabetical order; labelled rows that share an id count once, those without an id not at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, kept_by_worker
from .tokenization import blocks

ORDER = 3
SAMPLE_PER_LANGUAGE = 500
UNKNOWN = "und"
_START = b"\n" * ORDER


def folded(text: str) -> bytes:
    """The bytes that the models see."""
    return text.lower().encode("utf-8", "replace")


def grams(texts: list[bytes]) -> np.ndarray:
    """The run of four bytes that ends at each byte of each text, as one number; a text begins after line feeds."""
    parts = []
    for t in texts:
        s = np.frombuffer(_START + t, np.uint8).astype(np.uint32)
        parts.append(s[:-3] << np.uint32(24) | s[1:-2] << np.uint32(16) | s[2:-1] << np.uint32(8) | s[3:])
    return np.concatenate([*parts, np.empty(0, np.uint32)])


def counted(runs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct runs of 1 to ORDER + 1 bytes, as numbers, and how often each was seen."""
    return [np.unique(runs & np.uint32((1 << 8 * (k + 1)) - 1) if k < ORDER else runs, return_counts=True) for k in range(ORDER + 1)]


@dataclass
class Tree:
    """The context tree of one language: for each order the seen runs with their bits, and the contexts with their escapes."""

    runs: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def frozen(cls, counts: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
        """From distinct runs and their counts, order by order."""
        tree = cls([], [], [], [])
        for runs, times in counts:
            contexts, at = np.unique(runs >> np.uint32(8), return_inverse=True)
            totals, kinds = np.bincount(at, weights=times), np.bincount(at)
            tree.runs.append(runs)
            tree.bits.append(-np.log2(times / (totals + kinds)[at]) if len(runs) else np.empty(0))
            tree.contexts.append(contexts)
            tree.escapes.append(-np.log2(kinds / (totals + kinds)) if len(runs) else np.empty(0))
        return tree

    def code_lengths(self, runs: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run of four."""
        out, open_ = np.zeros(len(runs)), np.arange(len(runs))
        for k in range(ORDER, -1, -1):
            own = runs[open_] if k == ORDER else runs[open_] & np.uint32((1 << 8 * (k + 1)) - 1)
            seen, at = _found(self.runs[k], own)
            out[open_[seen]] += self.bits[k][at[seen]]
            open_, own = open_[~seen], own[~seen] >> np.uint32(8)
            known, at = _found(self.contexts[k], own)
            out[open_[known]] += self.escapes[k][at[known]]
        out[open_] += 8.0  # the uniform model over 256 bytes
        return out


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in a sorted table, and where."""
    at = np.searchsorted(table, keys)
    inside = at < len(table)
    inside[inside] = table[at[inside]] == keys[inside]
    return inside, at


@dataclass
class Model:
    """The trees of the languages, in alphabetical order."""

    languages: list[str] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        runs, inverse = np.unique(grams(texts), return_inverse=True)
        sizes = np.array([len(t) for t in texts], np.int64)
        there = np.flatnonzero(sizes)
        if len(there):
            starts = np.concatenate([[0], np.cumsum(sizes[there])[:-1]])
            for j, tree in enumerate(self.trees):
                out[there, j] = np.add.reduceat(tree.code_lengths(runs)[inverse], starts)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and bits a byte of each text."""
        names, scores, rates = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
        if not lettered or not self.languages:
            return names, scores, rates
        data = [folded(texts[i]) for i in lettered]
        bits = self.code_lengths(data)
        best = bits.argmin(axis=1)
        for k, i in enumerate(lettered):
            n = max(len(data[k]), 1)
            # Bytes depend on one another: the code lengths are tempered before they become a share.
            share = np.exp2(-(bits[k] - bits[k, best[k]]) / n**0.5)
            names[i], scores[i], rates[i] = self.languages[best[k]], float(1.0 / share.sum()), float(bits[k, best[k]] / n)
        return names, scores, rates


def train(samples: dict[str, list[bytes]]) -> Model:
    """Frozen statistics of sample texts by language."""
    languages = sorted(samples)
    return Model(languages, [Tree.frozen(counted(grams(samples[k]))) for k in languages])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, k, run, n: how often each run of k + 1 bytes was seen in the texts of a task, a block at a time."""
    kept_by_worker("language")
    for batch in batches:
        for rows, texts in blocks(batch, 1):
            labels = np.array(rows.column(0).to_pylist(), object)
            for lang in sorted(set(labels.tolist())):
                for k, (runs, n) in enumerate(counted(grams([folded(texts[i]) for i in np.flatnonzero(labels == lang)]))):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs), pa.string()), pa.array(np.full(len(runs), k, np.int32)), pa.array(runs.astype(np.int64)), pa.array(n)], names=["lang", "k", "run", "n"])


def _packed(table: pa.Table) -> pa.Table:
    """One row for each order of one language: its runs in ascending order and their counts, as bytes."""
    order, run, n = (table.column(c).to_numpy() for c in ("k", "run", "n"))
    rows = []
    for k in np.unique(order):
        at = np.flatnonzero(order == k)
        at = at[np.argsort(run[at])]
        rows.append((table.column("lang")[0].as_py(), int(k), run[at].astype("<u4").tobytes(), n[at].astype("<i8").tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["lang", "k", "runs", "n"])


def fit(df: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from the columns doc_id, text and lang of labelled rows; texts stay with the executors."""
    rows = bounded_sample(df.select("lang", "doc_id", "text"), "lang", "doc_id", F.lit(per_language))
    seen = rows.select("lang", "text").mapInArrow(_partial, "lang string, k int, run long, n long")
    seen = seen.groupBy("lang", "k", "run").agg(F.sum("n").alias("n"))
    found: dict[str, dict[int, tuple]] = {}
    for lang, k, runs, n in seen.groupBy("lang").applyInArrow(_packed, "lang string, k int, runs binary, n binary").collect():
        found.setdefault(lang, {})[k] = (np.frombuffer(bytes(runs), "<u4"), np.frombuffer(bytes(n), "<i8"))
    languages = sorted(found)
    return Model(languages, [Tree.frozen([found[lang][k] for k in range(ORDER + 1)]) for lang in languages])


def identify(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of df named in keep (default: doc_id) with lang_pred, score and bits_per_byte of every whole text."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = [doc_id] if keep is None else keep
    names = [f"__k{i}" for i in range(len(keep))]
    rows = df.select(F.col(text).alias("__text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = rows.select(*names).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("language")
        own = shared.value
        for batch in batches:
            for part, texts in blocks(batch, 0, 1 << 20):
                lang, score, rate = own.predict(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(i + 1) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[f.name for f in schema])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "lang_pred", "score", "bits_per_byte")
