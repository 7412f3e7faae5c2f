"""Best-fit packing of token sequences by the configuration linear program.

A configuration is a multiset of lengths that fits a sequence; the program asks for as few configurations as
cover the length histogram. It is solved by multiplicative weights: a knapsack dynamic program prices the
configurations under the present weights (one run gives, for every length, the best configuration that holds
it); those near the best get an amount, the share of the scarcest of their lengths, and a length's weight is
multiplied by exp(-STEP * what covers it / its count), run by run. In a run each weight is lowered by a little
chance besides, so that of the many configurations of the same price others are found each time.

Amounts are rounded to whole copies by largest remainder: first the whole parts, then one copy of each configuration
in the order of what is over, as long as its lengths are left. What no copy took is solved again, round by round,
until the number of sequences is within GAP of the bound that the weights prove, or a round takes nothing more. Only what is
left then is filled largest first, with exact complements where there are any.

The first attempt copies configurations without waste only. Where that stays above the bound (lengths that are few
have no exact fills), the program is solved once more with weights that move until primal and bound are within
SETTLED of each other, every configuration priced near the best is copied, and the plan of fewer sequences is taken.

Only the histogram (at most `capacity` numbers) reaches the driver, and only the configurations, whose number
does not depend on the rows, go back. Pieces are numbered within their length by counts for each length and
partition, so one length may hold most of the rows.

Defined results: a null text is an empty text; every document ends with the id `end`; equal documents and
repeated rows are packed each for itself; an empty table packs into no sequences.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64, release, stored
from .tokenization import ENCODER_BLOCK, blocks, encoder_of

CAPACITY, END = 4096, 1
#: Runs of the pricing program in each round, rounds, the step of the weights, the chance in them, and how far below the
#: best price a configuration of a run may be; the integer solution stops within GAP sequences of the bound.
RUNS, ROUNDS, STEP, CHANCE, NEAR_BEST, GAP = 30, 16, 0.002, 0.0005, 0.002, 1
#: For histograms without exact fills: most runs of a round, rounds, the step, the gap of primal and bound at which the
#: weights have settled, and how far below the best price a copied configuration may be; runs over many lengths are fewer.
PRICED_RUNS, PRICED_ROUNDS, PRICED_STEP, SETTLED, SLACK, MANY, FEWER = 300, 6, 0.05, 0.001, 0.01, 2000, 40


def cut_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = encoder_of(path, 0), np.array([end], "<u4").tobytes()
        for batch in batches:
            for rows, texts in blocks(batch, 0, ENCODER_BLOCK):
                which, piece, length, crc = [], [], [], []
                for i, own in enumerate(encoder.encode(texts)):
                    ids = own + last
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        which.append(i)
                        piece.append(p)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                piece = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(1).take(pa.array(which, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
            release()  # or a worker holds the most that any batch took

    rows = df.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def price(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the greatest weight within each capacity, and the length taken last (0: none).

    weights[l] is that of the length l, -inf where there is none; weights[0] is not used.
    """
    n = len(weights) - 1
    best, taken = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    there = np.flatnonzero(weights > -np.inf)
    there = there[there > 0]
    if (n // there).sum() <= MANY:  # length by length, a stretch of that length at a time
        for l in there.tolist():  # noqa: E741
            for at in range(l, n + 1, l):
                to = min(at + l, n + 1)
                gain = best[at - l : to - l] + weights[l]
                more = gain > best[at:to]
                best[at:to][more] = gain[more]
                taken[at:to][more] = l
        return best, taken
    for c in range(1, n + 1):
        gain = weights[1 : c + 1] + best[c - 1 :: -1] if c < n else weights[1:] + best[n - 1 :: -1]
        l = int(gain.argmax())  # noqa: E741
        if gain[l] > best[c - 1]:
            best[c], taken[c] = gain[l], l + 1
        else:
            best[c], taken[c] = best[c - 1], taken[c - 1]
    return best, taken


def _fillings(taken: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The distinct best configurations that hold each of the given lengths: rows of lengths in descending order, then zeros."""
    room, columns = len(taken) - 1 - first, [first]
    while (t := taken[room]).any():
        columns.append(t)
        room = room - t
    configs = -np.sort(-np.array(columns, np.int16 if len(taken) < 1 << 15 else np.int64).T, axis=1)
    return configs[np.unique(_hashed(configs), return_index=True)[1]]


def _hashed(configs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each configuration, whatever the order of its lengths; zeros don't count."""
    of = mix64(np.arange(int(configs.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(len(configs), np.uint64)
    for column in configs.T:
        out += of[column]
    return out


def _amounts(configs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An amount for each configuration, by its scarcest length, and what they cover of each length."""
    use = np.bincount(configs.ravel(), minlength=len(counts)).astype(float)
    share = np.full(len(counts), np.inf)
    there = np.flatnonzero(use[1:]) + 1
    share[there] = counts[there] / use[there]
    share[0] = np.inf
    x = share[configs].min(axis=1)
    covers = np.bincount(configs.ravel(), weights=np.repeat(x, configs.shape[1]), minlength=len(counts))
    covers[0] = 0
    return x, covers


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct configurations of several runs and the sums of their amounts."""
    width = max(c.shape[1] for c, _ in found)
    rows = np.concatenate([np.pad(c, ((0, 0), (0, width - c.shape[1]))) for c, _ in found])
    _, first, at = np.unique(_hashed(rows), return_index=True, return_inverse=True)
    return rows[first], np.bincount(at, weights=np.concatenate([x for _, x in found]))


def fractional(counts: np.ndarray, k: int = 0, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray, float]:
    """Configurations without waste, their amounts by multiplicative weights, and the best lower bound (from the dual); k seeds the chance."""
    n, rng = len(counts) - 1, np.random.default_rng(k)
    lengths = np.flatnonzero(counts)
    weights = np.full(n + 1, -np.inf)
    weights[lengths] = lengths / n
    # The lengths, as shares of the capacity, are feasible weights: the first bound.
    found, covered, bound = [], np.zeros(n + 1), float((counts * np.arange(n + 1)).sum()) / n
    for _ in range(runs):
        own = weights.copy()
        own[lengths] *= 1 - CHANCE * rng.random(len(lengths))
        best, taken = price(own)
        bound = max(bound, float((counts[lengths] * own[lengths]).sum() / best[n]))
        near = lengths[own[lengths] + best[n - lengths] >= (1 - NEAR_BEST) * best[n]]
        configs = _fillings(taken, near)
        x, covers = _amounts(configs, counts)
        covered += covers
        weights[lengths] *= np.exp(-STEP * covers[lengths] / counts[lengths])
        exact = configs.sum(axis=1) == n
        found.append((configs[exact], x[exact]))
    configs, x = _merged(found)
    return configs, x / (covered[lengths] / counts[lengths]).mean(), bound


def priced(counts: np.ndarray, k: int = 0, runs: int = PRICED_RUNS) -> tuple[np.ndarray, np.ndarray, float]:
    """Configurations that the settled weights price near the best, exact fills or not, their amounts, and the bound."""
    n = len(counts) - 1
    lengths = np.flatnonzero(counts)
    if (n // lengths).sum() > MANY:
        runs = min(runs, FEWER)
    weights = np.full(n + 1, -np.inf)
    weights[lengths] = lengths / n
    found, covered, bound, total, settled = [], np.zeros(n + 1), 0.0, 0.0, weights.copy()
    for _ in range(runs):
        best, taken = price(weights)
        dual = float((counts[lengths] * weights[lengths]).sum() / best[n])
        if dual > bound:
            bound, settled = dual, weights / best[n]
        configs = _fillings(taken, lengths[weights[lengths] + best[n - lengths] >= (1 - NEAR_BEST) * best[n]])
        x, covers = _amounts(configs, counts)
        found.append((configs, x))
        covered += covers
        total += float(x.sum())
        weights[lengths] *= np.exp(-PRICED_STEP * covers[lengths] / counts[lengths])
        least = float((covered[lengths] / counts[lengths]).min())
        if least and total / least <= (1 + SETTLED) * bound:
            break
    configs, x = _merged(found)
    settled[0] = 0.0
    good = settled[configs].sum(axis=1) >= 1 - SLACK
    return configs[good], x[good] / (covered[lengths] / counts[lengths]).mean(), bound


def _complement(left: np.ndarray, room: int) -> list[int]:
    """Lengths that are left for a gap: one or two that fill it exactly, else the longest that fits."""
    out = []
    there = left > 0
    while room > 0:
        if there[room] and left[room] > out.count(room):
            return [*out, room]
        pairs = np.flatnonzero(there[1:room] & there[room - 1 : 0 : -1]) + 1
        for a in pairs[: len(pairs) // 2 + 1][::-1].tolist():
            b = room - a
            if left[a] - out.count(a) >= 1 + (a == b) and left[b] - out.count(b) >= 1:
                return [*out, b, a]
        fits = np.flatnonzero(there[: room + 1])
        pick = next((int(x) for x in fits[::-1] if x and left[x] > out.count(x)), 0)
        if not pick:
            return out
        out.append(pick)
        room -= pick
    return out


def solve(counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """Configurations with their whole numbers of copies, which hold each length exactly as often as counted; a lower bound."""
    n = len(counts) - 1
    left = counts.astype(np.int64).copy()
    full = int(left[n])
    left[n] = 0
    plan, lower, rest = rounded(left, fractional, ROUNDS)
    plan += filled(rest)
    if _sequences(plan) > np.ceil(lower - 1e-9) + max(GAP, lower * SETTLED):
        other, dual, rest = rounded(left, priced, PRICED_ROUNDS)
        lower = max(lower, dual)
        plan = min(plan, other + filled(rest), key=_sequences)
    return ([((n,), full)] if full else []) + plan, full + lower


def _sequences(plan: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(copies for _, copies in plan)


def rounded(counts: np.ndarray, program: Callable, rounds: int) -> tuple[list[tuple[tuple[int, ...], int]], float, np.ndarray]:
    """Whole copies of the program's configurations by largest remainder, round by round, its bound, and what no copy took."""
    left, plan, lower = counts.copy(), [], 0.0
    for k in range(rounds):
        before = int(left.sum())
        if not before:
            break
        configs, amounts, dual = program(left, k)
        lower = lower or dual
        rows, whole = configs[np.argsort(-amounts, kind="stable")], np.sort(-amounts)
        _copy(rows, (-whole).astype(np.int64), left, plan)
        over = amounts - np.floor(amounts)
        _copy(configs[np.argsort(-over, kind="stable")], np.ones(len(over), np.int64), left, plan)
        if int(left.sum()) > 0.98 * before:
            break
    return plan, lower, left


def _copy(configs: np.ndarray, copies: np.ndarray, left: np.ndarray, plan: list[tuple[tuple[int, ...], int]], block: int = 1024) -> None:
    """Add as many copies of each configuration as wanted and there are lengths left for, in the given order."""
    wanted = copies > 0
    configs, copies, at = configs[wanted], copies[wanted], 0
    while at < len(configs):
        for config, most in zip(configs[at : at + block].tolist(), copies[at : at + block].tolist(), strict=True):
            need = Counter(config)
            need.pop(0, None)
            x = min(most, *(int(left[l]) // a for l, a in need.items()))  # noqa: E741
            if x:
                plan.append((tuple(l for l in config if l), x))  # noqa: E741
                for l, a in need.items():  # noqa: E741
                    left[l] -= a * x
        at += block
        there = left > 0
        there[0] = True
        able = there[configs[at:]].all(axis=1)  # those that lack a length are passed over at once
        configs, copies, at = configs[at:][able], copies[at:][able], 0


def filled(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """What is left, largest first, with exact complements where there are any."""
    n, left, plan = len(left) - 1, left.copy(), []
    while left.any():
        l = int(np.flatnonzero(left)[-1])  # noqa: E741
        left[l] -= 1
        config = tuple(sorted([l, *_complement(left, n - l)], reverse=True))
        left[l] += 1
        need = Counter(config)
        copies = min(int(left[x]) // a for x, a in need.items())
        plan.append((config, copies))
        for x, a in need.items():
            left[x] -= a * copies
    return plan


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of places by length: from the rank `rank` on, `each` a sequence from `sequence` on, the first at `offset`."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for config, copies in plan:
        at, i = 0, 0
        while i < len(config):
            l, each = config[i], config.count(config[i])  # noqa: E741
            rows.append((l, rank.get(l, 0), sequence, each, at))
            rank[l] = rank.get(l, 0) + each * copies
            at += each * l
            i += each
        sequence += copies
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Add sequence_id and offset to the rows of pieces, whose lengths are 1 to capacity."""
    rows = stored(pieces.withColumn("__part", F.spark_partition_id()), "pieces")
    counts = rows.groupBy(F.col(length).alias("__length"), "__part").agg(F.count(F.lit(1)).alias("__n"))
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("__length").agg(F.sum("__n").alias("n")).collect():
        hist[int(r[0])] = r[1]
    table = places(solve(hist)[0])
    before = F.sum("__n").over(Window.partitionBy("__length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("__length", F.col("__part").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part", length).orderBy(F.xxhash64(*pieces.columns)))
    ranked = rows.withColumn("__within", within - 1).join(base, (F.col(length) == F.col("__length")) & (F.col("__part") == F.col("__of")))
    ranked = ranked.withColumn("__rank", F.col("__within") + F.col("__before")).drop("__within", "__before", "__part", "__of", "__length")
    names = [c for c in ranked.columns if c != "__rank"]
    starts = table["length"] * (1 << 48) + table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l, r = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, "__rank"))
            at = np.searchsorted(starts, l * (1 << 48) + r, side="right") - 1
            copy, slot = np.divmod(r - table["rank"][at], table["each"][at])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(table["sequence"][at] + copy), pa.array(table["offset"][at] + slot * l)], names=[*names, "sequence_id", "offset"]
            )

    schema = ranked.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every document with their sequence and place."""
    return pack(cut_documents(df, path, capacity, end), capacity)
