"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 code points cuts a text wherever the hash falls under a threshold, so passages
that documents share are cut alike. A chunk is encoded once; its record holds the ids of the words that lie
wholly inside and the two pieces of words at its edges. Joins are repaired by re-encoding: the window starts
with the edge pieces of both chunks and grows over whole chunks until it is bounded by white space on both
sides, where the pre-tokenizer parts the text whatever stands around, so the ids agree exactly with those of
the whole text. Words are encoded once as well; one of letters and symbols behind them is put together from the
two, as the pre-tokenizer parts them. Chunks and words are kept in bounded number, so memory is bounded.

Defined results: a null text is an empty text, which has no ids and decodes to an empty text. Repeated rows
and repeated ids each keep their own row; columns other than the named ones are not read. Tokenizers that do
not drop white space, texts with the separators U+001C to U+001F (which the library does not count as white
space) and texts with the beginning of a special token are encoded whole.
"""

from __future__ import annotations

import functools
import gc
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, release

MEAN_CHUNK, MAX_CHUNK, WINDOW = 512, 8192, 16
#: Records of chunks (in each of two generations), words and parts of words that a worker keeps.
KEEP_CHUNKS, KEEP_WORDS, KEEP_PARTS = 4_000, 450_000, 500_000
#: Code points that are worked on at once; the encoder takes more, as words are then looked up in fewer rounds.
BLOCK, ENCODER_BLOCK = 1 << 20, 1 << 21
#: New words that wait at most (but for those of one chunk), and strings that the library encodes at once: its results are large.
WAIT, AT_ONCE = 1 << 15, 1 << 12
_BASE, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: A word of folded letters and, behind them, symbols, all under U+0100 (no apostrophe: it may begin a contraction).
_LETTERS = re.escape("".join(c for c in map(chr, range(256)) if c.isalpha() and c == c.lower()))
_MARKS = re.escape("".join(c for c in map(chr, range(256)) if not (c.isalnum() or c.isspace() or c == "'")))
_LATIN = re.compile(f"([{_LETTERS}]+)?([{_MARKS}]+)?")
#: Text beyond those code points keeps its case until the library folds it.
_BEYOND = re.compile("[^\x00-\xff]")


def cuts(text: str, mean: int = MEAN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the content-defined chunks of a text, in code points; the last is its length."""
    n = len(text)
    if n <= WINDOW:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    base, width = _BASE, 1
    with np.errstate(over="ignore"):
        while width < WINDOW:  # each step doubles the width of the windows
            h = h[:-width] * base + h[width:]
            base, width = base * base, 2 * width
        at = np.flatnonzero(h * _SPREAD < np.uint32((1 << 32) // mean)) + WINDOW
    ends, last = [], 0
    for e in [*at.tolist(), n]:
        while e - last > most:
            last += most
            ends.append(last)
        if e > last:
            ends.append(e)
            last = e
    return ends


class _Kept:
    """A mapping of bounded size: what has not been used for a generation is forgotten."""

    def __init__(self, keep: int) -> None:
        self.keep, self.new, self.old = keep, {}, {}

    def get(self, key: str):
        x = self.new.get(key)
        if x is None:
            x = self.old.get(key)
            if x is not None:
                self.put(key, x)
        return x

    def put(self, key: str, x: tuple) -> None:
        if len(self.new) >= self.keep:
            self.old, self.new = self.new, {}
        self.new[key] = x


class _Words(dict):
    """Numbers of words; a new word gets the next number and waits in `new`, with its parts, to be encoded.

    A word of Latin letters with symbols behind it has two parts, which the pre-tokenizer parts as well.
    """

    def __init__(self, folds: bool) -> None:
        super().__init__()
        self.new: list[tuple[str, ...]] = []
        self.names: list[str] = []
        self.folds = folds

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.names.append(word)
        m = _LATIN.fullmatch(word) if self.folds else None
        self.new.append(m.groups("") if m else (word,))
        return n


class _Frequent(dict):
    """Numbers of the most frequent words, few enough for a processor's cache; others are looked up in `words`."""

    def __init__(self, words: _Words, numbers: np.ndarray, most: int = 1 << 14) -> None:
        counts = np.bincount(numbers, minlength=1)
        top = np.argsort(-counts, kind="stable")[:most]
        super().__init__((words.names[n], n) for n in top[counts[top] > 1].tolist())
        self.words = words

    def __missing__(self, word: str) -> int:
        return self.words[word]


def _encoded(tokenizer, strings: list[str]) -> Iterator[bytes]:
    """The ids of each string, a few strings at once."""
    for at in range(0, len(strings), AT_ONCE):
        for e in tokenizer.encode_batch_fast(strings[at : at + AT_ONCE], add_special_tokens=False):
            yield array("I", e.ids).tobytes()


class ChunkEncoder:
    """Encodes texts with a tokenizer file, reusing chunks and words; a mean of 0 takes whole texts for chunks and keeps none."""

    def __init__(self, path: str, mean: int = MEAN_CHUNK) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.mean = Tokenizer.from_file(path), mean
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        first = (described.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        pattern = str(first.get("pattern"))
        #: White space parts the text and leaves no token; so do the bounds of runs of symbols.
        self.by_words = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and r"[^\\s\\p{L}\\p{N}]+" in pattern
        #: Letters are folded to lower case at the end of normalizing.
        self.folds = self.by_words and str(described.get("normalizer")).endswith("{'type': 'Lowercase'}]}")
        #: For words of folded Latin letters, which normalizing and splitting leave as they are: the merges alone (one model for both).
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain_decoder = described.get("decoder") is None
        self.chunks = _Kept(KEEP_CHUNKS)
        self.parts: dict[str, bytes] = {"": b""}
        self._forget(_Words(self.folds), np.empty(0, np.uint32), np.empty(0, np.int64))
        self.encoded_chunks = self.reused_chunks = 0

    @functools.cached_property
    def name_of(self):
        """The name of an id; packing needs none."""
        return {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}.__getitem__

    def _forget(self, words: _Words, ids: np.ndarray, ends: np.ndarray) -> None:
        """Start over with the given words, their ids one after another, and where each word's ids end."""
        self.words, self.ids, self.ends = words, ids, ends
        self.number = words

    def _learn(self) -> None:
        """Encode the words that wait: the parts of letters or symbols that are new by the merges alone, other words as they are."""
        if not self.words.new:
            return
        parts = self.parts
        if len(parts) > KEEP_PARTS:
            parts.clear()
            parts[""] = b""
        wanted = list({p for w in self.words.new if len(w) == 2 for p in w if p not in parts})
        parts.update(zip(wanted, _encoded(self.merges, wanted), strict=True))
        others = _encoded(self.tokenizer, [w[0] for w in self.words.new if len(w) == 1])
        found = [parts[w[0]] + parts[w[1]] if len(w) == 2 else next(others) for w in self.words.new]
        base = self.ends[-1] if len(self.ends) else 0
        self.ends = np.concatenate([self.ends, base + np.cumsum([len(x) for x in found]) // 4])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])
        self.words.new = []

    def _keep(self, numbers: np.ndarray) -> bool:
        """Where there are too many words, forget those that are not among the numbers; whether the words have new numbers."""
        full = len(self.words) > KEEP_WORDS
        if full:
            used = np.unique(numbers)
            starts, ends = self.ends[used] - self._lengths()[used], self.ends[used]
            ids = [self.ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            old, words = self.words.names, _Words(self.folds)
            for n in used.tolist():
                words[old[n]]
            words.new = []
            self._forget(words, np.concatenate([*ids, np.empty(0, np.uint32)]), np.cumsum([len(x) for x in ids], dtype=np.int64))
        return full

    def _lengths(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def _flat(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words one after another, and where each word's begin (with the end)."""
        lengths = self._lengths()[numbers]
        at = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.repeat(self.ends[numbers] - lengths - at[:-1], lengths) + np.arange(at[-1])], at

    @staticmethod
    def _parts(chunk: str, number: Callable[[str], int]) -> tuple[str | None, list[int], str | None]:
        """Edge piece, numbers of the whole words, edge piece; (None, [], None) for a chunk without white space."""
        words = chunk.split()
        if not words:
            return "", [], ""
        head, tail = not chunk[0].isspace(), not chunk[-1].isspace()
        if len(words) == 1 and head and tail:
            return None, [], None
        return words[0] if head else "", list(map(number, words[int(head) : len(words) - int(tail)])), words[-1] if tail else ""

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers.

        No reference cycles come up in it, so the search for them, which the many small objects would set off, rests.
        """
        resting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if resting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        plans, fresh, known, number = [], {}, {}, self.number.__getitem__
        joins: list[str] = []
        for text in texts:
            if any(s in text for s in _WHOLE):
                plans.append(None)
                continue
            if self.folds and not _BEYOND.search(text):
                text = text.lower()
            plan, at, open_word = [], 0, []
            for e in cuts(text, self.mean) if self.mean else [len(text)] if text else []:
                chunk = text[at:e]
                at = e
                kept = fresh.get(chunk) or known.get(chunk)
                if kept is None:
                    kept = self.chunks.get(chunk) if self.mean else None
                    if kept is None:
                        kept = fresh[chunk] = self._parts(chunk, number)
                        if len(self.words.new) >= WAIT:
                            self._learn()
                    else:
                        known[chunk] = kept
                        self.reused_chunks += 1
                head, _, tail = kept
                if head is None:  # no white space: the window grows
                    open_word.append(chunk)
                    continue
                open_word.append(head)
                word = "".join(open_word)
                if word:
                    plan.append(len(joins))
                    joins.append(word)
                plan.append(chunk)
                open_word = [tail]
            word = "".join(open_word)
            if word:
                plan.append(len(joins))
                joins.append(word)
            plans.append(plan)
        self.encoded_chunks += len(fresh)
        closed = [(c, x) for c, x in fresh.items() if x[0] is not None]
        sizes = [len(x[1]) for _, x in closed]
        numbers = np.fromiter(chain(map(number, joins), chain.from_iterable(x[1] for _, x in closed)), np.int64, len(joins) + sum(sizes))
        self._learn()
        flat, starts = self._flat(numbers)
        data = flat.tobytes()
        bounds = (starts[np.concatenate([np.arange(len(joins)), len(joins) + np.cumsum([0, *sizes])])] * 4).tolist()
        pieces: dict = {c: x[1] for c, x in known.items()}
        for i in range(len(joins)):
            pieces[i] = data[bounds[i] : bounds[i + 1]]
        for i, (chunk, (head, _, tail)) in enumerate(closed, len(joins)):
            pieces[chunk] = data[bounds[i] : bounds[i + 1]]
            if self.mean:
                self.chunks.put(chunk, (head, pieces[chunk], tail))
        if not self._keep(numbers) and self.number is self.words and len(numbers) > 1 << 16:
            self.number = _Frequent(self.words, numbers)
        return [
            b"".join([pieces[x] for x in plan]) if plan is not None else array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() for text, plan in zip(texts, plans, strict=True)
        ]

    def decode(self, ids: bytes) -> str:
        """The text of ids: token names parted by spaces, or what the tokenizer's own decoder makes of them."""
        numbers = array("I", ids).tolist()
        return " ".join(map(self.name_of, numbers)) if self.plain_decoder else self.tokenizer.decode(numbers, skip_special_tokens=False)


def encoder_of(path: str, mean: int = MEAN_CHUNK) -> ChunkEncoder:
    """The encoder of a worker process; what it has learnt serves the worker's later tasks too."""
    return kept_by_worker(f"encoder {mean} {path}", lambda: ChunkEncoder(path, mean))


def blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty), of about as many code points at most."""
    at, size, texts = 0, 0, []
    col = batch.column(column)
    for i in range(batch.num_rows):
        t = col[i].as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= most:
            yield batch.slice(at, i + 1 - at), texts
            at, size, texts = i + 1, 0, []
    if texts:
        yield batch.slice(at), texts


def encode_documents(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string for every row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for rows, texts in blocks(batch, 1, ENCODER_BLOCK):
                ids = encoder.encode(texts)
                decoded = [encoder.decode(x) for x in ids]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
            release()  # or a worker holds the most that any batch took

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
