"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, the assistant last. Dynamic
programming over this automaton finds, for the turns as they are, the cheapest mix of keeping a role, giving it
another one, merging a turn into the one before, and inserting an empty turn; the repaired sequence is rendered
as <|role|>, a line feed, the text, a line feed, <|end|> and a line feed for every turn.

Turns are dealt to ranges of (conversation, turn), so one conversation may hold most of the rows: a first pass
reduces each range's share of the conversations at its two ends to a matrix of state-to-state costs (the
programme is a product of such matrices), the driver picks the states at the range bounds from these two
matrices a range, and a second pass repairs and renders every range on its own. The result has one row for each
input turn; the `rendered` pieces of a conversation in the order of position (and of turn) make its rendering.

Defined results: turns are ordered by turn (null first), ties by a hash of role and text; a null conversation id
is a conversation of its own; a null text is empty; role names are compared without case and white space, and
with the aliases below; null and unknown roles are free to become what is cheapest at a small cost. "<|" in a
text is written "<\\|". Repeated rows are turns of their own. An empty table has no turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import bounds, bucket

#: States (the role of the last turn), role codes and aliases, costs.
START, SYSTEM, USER, ASSISTANT, UNKNOWN = 0, 1, 2, 3, 4
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT, "developer": SYSTEM, "human": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "ai": ASSISTANT, "model": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
LEGAL = frozenset({(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)})
MERGE, INSERT, RELABEL, NAME = 2, 3, 4, 1
NEVER = 10**9
PARTS_PER_PARTITION = 2


def _step(state: int, role: int, to: int) -> tuple[int, str, int]:
    """Cheapest way from a state over a turn of a role to a state: cost, action, inserted role (0: none)."""
    if to == START:
        return NEVER, "", 0
    label = 0 if role == to else NAME if role == UNKNOWN else RELABEL
    kept = "keep" if role == to else "relabel"
    ways = []
    if (state, to) in LEGAL:
        ways.append((label, 0, kept, 0))
    if state == to:
        ways.append((MERGE + label, 1, "merge", 0))
    ways += [(INSERT + label, 2, kept, x) for x in (SYSTEM, USER, ASSISTANT) if (state, x) in LEGAL and (x, to) in LEGAL]
    cost, _, action, inserted = min(ways, default=(NEVER, 0, "", 0))
    return cost, action, inserted


STEPS = {(s, r, t): _step(s, r, t) for s in range(4) for r in range(1, 5) for t in range(4)}
COSTS = {r: np.array([[STEPS[s, r, t][0] for t in range(4)] for s in range(4)], np.int64) for r in range(1, 5)}
#: A conversation that ends with the user's (or the system's) turn gets an empty assistant turn.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def role_code(role: str | None) -> int:
    return ROLES.get((role or "").strip().lower(), UNKNOWN)


def product(roles: list[int]) -> np.ndarray:
    """State-to-state costs of a stretch of turns."""
    out = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)
    for r in roles:
        out = np.minimum((out[:, :, None] + COSTS[r][None, :, :]).min(axis=1), NEVER)
    return out


def repair(roles: list[int], entry: int = START, exit_costs: np.ndarray = END) -> list[tuple[int, str, int]]:
    """State, action and inserted role of every turn on the cheapest path; ties go to the smaller state."""
    cost, back = np.full(4, NEVER, np.int64), []
    cost[entry] = 0
    for r in roles:
        ways = cost[:, None] + COSTS[r]
        back.append(ways.argmin(axis=0))
        cost = np.minimum(ways.min(axis=0), NEVER)
    state, out = int((cost + exit_costs).argmin()), []
    for r, b in zip(reversed(roles), reversed(back), strict=True):
        before = int(b[state])
        out.append((state, *STEPS[before, r, state][1:]))
        state = before
    return out[::-1]


def _turn(role: int, text: str) -> str:
    return f"<|{NAMES[role]}|>\n{text}"


def render(texts: list[str], found: list[tuple[int, str, int]], first: bool, last: bool) -> list[str]:
    """The piece of every turn; first and last: whether the stretch begins and ends its conversation."""
    out = []
    for i, (text, (state, action, inserted)) in enumerate(zip(texts, found, strict=True)):
        text = text.replace("<|", "<\\|")
        if action == "merge":
            piece = f"\n{text}"
        else:
            piece = "" if first and i == 0 else "\n<|end|>\n"
            if inserted:
                piece += _turn(inserted, "") + "\n<|end|>\n"
            piece += _turn(state, text)
        if last and i == len(texts) - 1:
            piece += "\n<|end|>\n"
            for x in ((USER, ASSISTANT) if state == SYSTEM else (ASSISTANT,) if state == USER else ()):
                piece += _turn(x, "") + "\n<|end|>\n"
        out.append(piece)
    return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[list]]]:
    """Bucket, conversation and the columns of each run of rows with the same two, across batches."""
    key, columns = None, None
    for batch in batches:
        values = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*values, strict=True):
            if row[:2] != key:
                if columns is not None:
                    yield *key, columns
                key, columns = row[:2], [[] for _ in row[2:]]
            for c, v in zip(columns, row[2:], strict=True):
                c.append(v)
    if columns is not None:
        yield *key, columns


def format_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, position, role, action, inserted, rendered for every row of conv_id, turn, role, text."""
    spark = df.sparkSession
    keys = ["conv_id", "turn", "tie"]
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * PARTS_PER_PARTITION
    of = bounds(rows, keys, parts)
    dealt = rows.withColumn("b", bucket(of, keys))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for b, conv, (roles,) in _stretches(batches):
            m = product([role_code(r) for r in roles]).ravel().tolist()
            first = seen.setdefault(b, [conv, m, conv, m, 1, 0])
            first[2:4] = [conv, m]
            first[4] = 1 if first[1] is m else 2
            first[5] = len(roles)
        for b, (c1, m1, c2, m2, n, turns) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([c1], pa.int64()), pa.array([m1], pa.list_(pa.int64())), pa.array([c2], pa.int64()), pa.array([m2], pa.list_(pa.int64())), pa.array([n], pa.int32()), pa.array([turns], pa.int64())], names=["b", "c1", "m1", "c2", "m2", "n", "turns"])

    slim = dealt.select("b", "conv_id", "turn", "tie", "role").repartition("b").sortWithinPartitions("b", "conv_id", "turn", "tie").select("b", "conv_id", "role")
    found = sorted(slim.mapInArrow(ends, "b int, c1 long, m1 array<long>, c2 long, m2 array<long>, n int, turns long").collect(), key=lambda r: r["b"])
    entry, leave = _boundaries([(r["b"], r["c1"], np.array(r["m1"]).reshape(4, 4), r["c2"], np.array(r["m2"]).reshape(4, 4), r["n"], r["turns"]) for r in found])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_bucket, at_start = None, True
        for b, conv, (turns, roles, texts) in _stretches(batches):
            at_start, last_bucket = b != last_bucket, b
            before = entry.get(b) if at_start else None
            after = leave.get(b)
            goes_on = after is not None and after[0] == conv
            exits = np.where(np.arange(4) == after[1], 0, NEVER) if goes_on else END
            codes = [role_code(r) for r in roles]
            path = repair(codes, before[0] if before else START, exits)
            pieces = render(texts, path, before is None, not goes_on)
            base = before[1] if before else 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv] * len(codes), pa.int64()), pa.array(turns, pa.int64()), pa.array([base + i for i in range(len(codes))], pa.int64()),
                    pa.array([NAMES[p[0]] for p in path]), pa.array([p[1] for p in path]), pa.array([NAMES[p[2]] or None for p in path], pa.string()), pa.array(pieces),
                ],
                names=["conv_id", "turn", "position", "role", "action", "inserted", "rendered"],
            )

    full = dealt.repartition("b").sortWithinPartitions("b", "conv_id", "turn", "tie").select("b", "conv_id", "turn", "role", "text")
    return full.mapInArrow(work, "conv_id long, turn long, position long, role string, action string, inserted string, rendered string")


def _boundaries(of: list[tuple]) -> tuple[dict, dict]:
    """Entry state of the first conversation of a range where it goes on from the range before, with its turns until there, and exit
    state of the last where it goes on.

    Cheapest paths through a chain of ranges that share a conversation: costs to come from the back, then states from the front.
    """
    entry: dict[int, tuple[int, int]] = {}
    leave: dict[int, tuple[object, int]] = {}
    i = 0
    while i < len(of):
        j = i
        while j + 1 < len(of) and of[j + 1][1] == of[j][3] and (j == i or of[j][5] == 1):
            j += 1
        if j > i:  # ranges i to j share the conversation of[i][3]
            to_come = [END]
            for k in range(j, i, -1):
                to_come.append(np.minimum((of[k][2] + to_come[-1][None, :]).min(axis=1), NEVER))
            to_come.reverse()  # after the last stretch of range i, i + 1, ...
            state, turns = START, 0
            for k in range(i, j):
                turns += of[k][6]
                m = of[k][4] if k == i else of[k][2]
                state = int((m[state] + to_come[k - i]).argmin())
                leave[of[k][0]] = (of[k][3], state)
                entry[of[k + 1][0]] = (state, turns)
        i = max(j, i + 1)
    return entry, leave
