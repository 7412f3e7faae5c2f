"""Personal data: fixed patterns, and further spans from a semi-Markov conditional random field.

Base spans follow four patterns (e-mail, IPv4 address, payment card, international phone number), leftmost and
not overlapping within a kind; matches that fail their test are dropped without another try. The random field
then reads the stretches around digits, @ signs and written-out dots: every run of tokens, of whatever length,
that could be an entity is a candidate segment, described by features of the whole span (its digits, check sum,
grouping, parts and neighbours), and dynamic programming over segments and the label before chooses boundaries
and kinds together. Segments of digits end with the last kind's most digits; the others are as long as their run of characters, whose
features come from running counts, so the work follows the length of a text whatever is in it. What it finds beside the base spans is added; base spans always stay. Its weights are
trained on a few hundred lines that a seeded rule writes, by gradient ascent on the likelihood.

Defined results: a null text is an empty text and has no spans; offsets count code points, the end is exclusive;
spans are ordered by start, then kind as listed in KINDS; equal texts get equal spans. Columns other than the
named ones are not read.
"""

from __future__ import annotations

import functools
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_by_worker
from .tokenization import blocks

#: The kinds in their order, and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone", "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

REACH = 48
EPOCHS, STEP, DECAY, LINES = 60, 0.5, 1e-4, 320
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W_]+|\s+|.", re.S)
_SPACE = re.compile(r"\s")
_RUN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_AT = re.compile(r" ?[\[({ ]at[\])} ]", re.I)
_LOCAL_START = re.compile(r"[A-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9]|@|[\[({ ](?:at|dot)[\])} ]", re.I)
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[({ ](?:at)[\])} ] ?[A-Za-z0-9-]+(?: ?[\[({ ](?:dot)[\])} ] ?[A-Za-z0-9-]+)+", re.I)
_CUES = {"email": "mail email contact write reach", "ip": "ip host server address addr ping", "card": "card visa credit debit payment pan", "phone": "phone tel call fax mobile telephone cell", "secret": "token key secret password passwd pwd apikey bearer auth"}
_CUE = {w: k for k, v in _CUES.items() for w in v.split()}


def luhn(digits: str) -> bool:
    """Whether a card number's check sum holds."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of e-mail addresses; each @ is looked at once, so long runs of address characters cost no more."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1)
        if start < at and m:
            last = m.end()
            out.append((start, last))
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four fixed patterns, ordered."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold entities: REACH code points around each trigger and the whole words that these reach into, merged."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() - REACH <= out[-1][1]:
            out[-1][1] = max(out[-1][1], m.end() + REACH)
        else:
            out.append([max(0, m.start() - REACH), m.end() + REACH])
    whole: list[tuple[int, int]] = []
    for a, b in out:
        last = whole[-1][1] if whole else 0
        if b <= last:
            continue
        while a > last and not text[a - 1].isspace():
            a -= 1
        space = _SPACE.search(text, b)
        b = space.start() if space else len(text)
        if whole and a <= last:
            whole[-1] = (whole[-1][0], b)
        else:
            whole.append((a, b))
    return whole


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Offsets of the tokens of a stretch; words cut by its ends are left whole by the caller's context features."""
    return [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]


def _context(text: str, start: int) -> str:
    """The kind that one of the two words before a span points to, if any."""
    for w in reversed(re.findall(r"[A-Za-z]+", text[max(0, start - 24) : start])[-2:]):
        if w.lower() in _CUE:
            return _CUE[w.lower()]
    return ""


def features(kind: str, text: str, start: int, end: int) -> list[str] | None:
    """Names of the features of a whole span as an entity of a kind; None where it can't be one."""
    span = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    out = ["bias", f"cue={_context(text, start) == kind}", f"open={before.isalnum()}", f"shut={after.isalnum()}", f"dotted={before in ('.', '-', '/', '_')}{after in ('-', '/', '_')}"]
    digits = sum(map(str.isdigit, span))
    if kind == "secret":
        return _secret(text, start, end, digits, all(c in "0123456789abcdef" for c in span)) if _RUN.fullmatch(span) else None
    if kind == "email":
        if not _WRITTEN.fullmatch(span):
            return None
        out += [f"brackets={any(c in span for c in '[({')}", f"dots={min(len(re.findall('dot', span, re.I)), 3)}", f"tail={len(re.split(r'[^A-Za-z0-9-]+', span)[-1]) in (2, 3, 4)}"]
    else:
        if not digits or not re.fullmatch(r"[0-9(+][0-9 ().-]*[0-9]", span):
            return None
        groups = re.findall(r"[0-9]+", span)
        seps = re.sub(r"[0-9]", "", span)
        if kind == "ip":
            if len(groups) != 4 or set(seps) != {"."} or "." not in span:
                return None
            out += [f"small={all(len(g) <= 3 and int(g) <= 255 for g in groups)}", f"spaced={len(seps) != 3}", f"zero={any(len(g) > 1 and g[0] == '0' for g in groups)}"]
        elif kind == "card":
            if not 12 <= digits <= 19 or not set(seps) <= set(" -."):
                return None
            out += [f"luhn={luhn(''.join(groups))}", f"even={len({len(g) for g in groups}) == 1}", f"kinds={len(set(seps))}", f"sixteen={digits == 16}"]
        else:
            if not 7 <= digits <= 15 or len(groups) < 2 or not set(seps) <= set(" ().-+"):
                return None
            out += [f"groups={min(len(groups), 6)}", f"last={len(groups[-1])}", f"plus={span[0] == '+'}", f"paren={'(' in span}{span.count('(') == span.count(')')}", f"longest={min(max(map(len, groups)), 6)}", f"digits={digits}", f"dots={'.' in seps}"]
    return [f"{kind}:{x}" for x in out]


def _secret(text: str, start: int, end: int, digits: int, low_hex: bool) -> list[str]:
    """The features of a run of key characters, given how many are digits and whether all are of lower hexadecimal."""
    size, before, after = end - start, text[start - 1 : start], text[end : end + 1]
    set_ = bool(re.search(r"[=:]\s*[\"']?$", text[max(0, start - 6) : start]))
    out = ["bias", f"cue={_context(text, start) == 'secret'}", f"open={before.isalnum()}", f"shut={after.isalnum()}", f"dotted={before in ('.', '-', '/', '_')}{after in ('-', '/', '_')}"]
    out += [f"hex={low_hex}", f"mixed={0.1 < digits / size < 0.9}", f"long={min(size // 8, 6)}", f"set={set_}", f"pure={digits == size}"]
    return [f"secret:{x}" for x in out]


def candidates(text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int, str, list[str]]]:
    """Segments (first token, token after, kind, features) that could be entities."""
    out = []
    if not toks:
        return out
    lo, hi = toks[0][0], toks[-1][1]
    starts, ends = {a: i for i, (a, _) in enumerate(toks)}, {b: i for i, (_, b) in enumerate(toks)}
    for i, (a, b) in enumerate(toks):
        c = text[a]
        if c not in "0123456789(+" or c in "(+" and not (text[a + 1 : a + 2].isdigit() or text[a + 1 : a + 2] == "(" and text[a + 2 : a + 3].isdigit()):
            continue
        digits = dots = 0
        for j in range(i, len(toks)):
            first, e = text[toks[j][0]], toks[j][1]
            if not (first in "0123456789" or first in " ().-+"):
                break
            if first not in "0123456789":
                dots += first == "."
                continue
            digits += e - toks[j][0]
            if digits > 19:  # no kind has more
                break
            kinds = [k for k, able in (("ip", dots == 3), ("card", digits >= 12), ("phone", j > i and 7 <= digits <= 15)) if able]
            for k in kinds:
                if (f := features(k, text, a, e)) is not None:
                    out.append((i, j + 1, k, f))
    for m in _RUN.finditer(text, lo, hi):
        j = ends.get(m.end())
        if j is None:
            continue
        digits, low_hex = sum(map(str.isdigit, m[0])), max((k for k, c in enumerate(m[0]) if c not in "0123456789abcdef"), default=-1)
        at = m.start()
        for i in range(starts.get(at, j + 1), j + 1):
            a = toks[i][0]
            if m.end() - a < 16:
                break
            digits -= sum(map(str.isdigit, text[at:a]))
            at = a
            if text[a].isalnum() and (a == lo or not (text[a - 1].isalnum() or text[a - 1] == "_")):
                out.append((i, j + 1, "secret", _secret(text, a, m.end(), digits, low_hex < a - m.start())))
    for m in _AT.finditer(text, lo, hi):
        a = m.start()
        while a > lo and text[a - 1] in LOCAL:
            a -= 1
        first = _LOCAL_START.search(text, a, m.start())
        whole = _WRITTEN.match(text, first.start(), hi) if first else None
        if whole and whole.start() in starts and whole.end() in ends and (f := features("email", text, *whole.span())) is not None:
            out.append((starts[whole.start()], ends[whole.end()] + 1, "email", f))
    return sorted(out, key=lambda x: x[:2])


class SemiMarkov:
    """The random field: weights of features, and of the label that the segment before has."""

    def __init__(self) -> None:
        self.w: dict[str, float] = {}

    def score(self, feats: list[str]) -> float:
        return sum(self.w.get(f, 0.0) for f in feats)

    def best(self, n: int, segs: list[tuple[int, int, str, list[str]]]) -> list[tuple[int, int, str]]:
        """The segments of the best labelling of n tokens."""
        into: dict[int, list] = {}
        for i, j, k, f in segs:
            into.setdefault(j, []).append((i, k, self.score(f)))
        labels = ("O", *KINDS)
        at = [{"O": (0.0, None)}]
        for j in range(1, n + 1):
            row: dict[str, tuple] = {}
            top = max(at[j - 1].items(), key=lambda x: x[1][0] + self.w.get(f"after:{x[0]}>O", 0.0))
            row["O"] = (top[1][0] + self.w.get(f"after:{top[0]}>O", 0.0), (j - 1, top[0]))
            for i, k, s in into.get(j, ()):
                p = max(at[i].items(), key=lambda x: x[1][0] + self.w.get(f"after:{x[0]}>{k}", 0.0))
                v = p[1][0] + self.w.get(f"after:{p[0]}>{k}", 0.0) + s
                if k not in row or v > row[k][0]:
                    row[k] = (v, (i, p[0]))
            at.append(row)
        out, j = [], n
        label = max((x for x in labels if x in at[n]), key=lambda x: at[n][x][0])
        while j > 0:
            i, before = at[j][label][1]
            if label != "O":
                out.append((i, j, label))
            j, label = i, before
        return out[::-1]

    def expected(self, n: int, segs: list[tuple[int, int, str, list[str]]]) -> tuple[dict[str, float], float]:
        """Expected feature counts under the model, and the log of the partition sum."""
        arcs = [(j - 1, j, "O", []) for j in range(1, n + 1)] + segs
        arcs.sort(key=lambda a: (a[1], a[0]))
        weight = [self.score(a[3]) for a in arcs]
        forward: list[dict[str, float]] = [{"O": 0.0}] + [{} for _ in range(n)]
        add = lambda a, b: b if a is None else max(a, b) + math.log1p(math.exp(-abs(a - b)))
        for (i, j, k, _), s in zip(arcs, weight, strict=True):
            for before, v in forward[i].items():
                forward[j][k] = add(forward[j].get(k), v + s + self.w.get(f"after:{before}>{k}", 0.0))
        backward: list[dict[str, float]] = [{} for _ in range(n)] + [dict.fromkeys(forward[n], 0.0)]
        total = functools.reduce(add, forward[n].values(), None)
        out: dict[str, float] = {}
        for (i, j, k, f), s in sorted(zip(arcs, weight, strict=True), key=lambda a: (-a[0][0], -a[0][1])):
            if k not in backward[j]:
                continue
            for before, v in forward[i].items():
                step = s + self.w.get(f"after:{before}>{k}", 0.0) + backward[j][k]
                backward[i][before] = add(backward[i].get(before), step)
                p = math.exp(v + step - total)
                for x in [*f, f"after:{before}>{k}"]:
                    out[x] = out.get(x, 0.0) + p
        return out, total


def written_lines(seed: int = 7, lines: int = LINES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: lines by a seeded rule, with entities in plain and unusual forms, and with look-alikes."""
    r = random.Random(seed)
    words = "the of and order on was von les una shipped to by since about total page in room near model with der die".split()
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8)))

    def card() -> str:
        x = d(15)
        x += next(c for c in "0123456789" if luhn(x + c))
        sep = r.choice(["", " ", "-", "."])
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"0{d(2)} {d(3)} {d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])

    def email() -> str:
        at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]")])
        return f"{name()}{at}{name()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"

    make = {
        "email": email,
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": phone,
        "secret": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))),
    }
    noise = [
        lambda: d(r.randint(1, 11)), lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1950, 2030)}", lambda: f"{r.randint(1950, 2030)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}",
        lambda: f"{d(1)}.{d(3)}.{d(3)}", lambda: f"{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}", lambda: f"{d(4)} - {d(4)}", lambda: f"{d(3)} {d(3)}", lambda: f"{r.randint(256, 999)}.{d(3)}.{r.randint(300, 999)}.{d(3)}",
        lambda: f"@{name()}", lambda: f"met at noon dot", lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", lambda: "".join(r.choice("abcdefgh") for _ in range(20)), lambda: f"{d(20)}", lambda: f"{d(1)}, {d(1)} and {d(2)}", lambda: f"{d(16)}" if False else d(24),
        lambda: f"{d(2)} {d(2)} {d(2)}", lambda: f"{d(4)} {d(1)} {d(4)}",
    ]

    def bad_card() -> str:
        x = d(16)
        return x if not luhn(x) else x[:-1] + str((int(x[-1]) + 1) % 10)

    out = []
    for _ in range(lines):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(r.choice(words) for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.55:
                k = r.choice(KINDS)
                cue = r.random() < 0.5 or k == "secret"
                if cue:
                    text += r.choice(_CUES[k].split()) + r.choice([" ", ": ", " = "] if k != "secret" else [" = ", ": ", "=", ' = "', '="'])
                x = make[k]()
                spans.append((k, len(text), len(text) + len(x)))
                text += x + ('"' if text[-1:] == '"' else "") + r.choice([" ", ", ", ". "])
            else:
                text += (bad_card() if r.random() < 0.2 else r.choice(noise)()) + r.choice([" ", ", ", ". "])
        out.append((text, spans))
    return out


@functools.cache
def trained(seed: int = 7, lines: int = LINES, epochs: int = EPOCHS) -> SemiMarkov:
    """The field fitted to the written lines by full-batch gradient ascent with adaptive steps."""
    field, batch = SemiMarkov(), []
    for text, spans in written_lines(seed, lines):
        toks = tokens(text, 0, len(text))
        segs = candidates(text, toks)
        starts, ends = {a: i for i, (a, _) in enumerate(toks)}, {b: i + 1 for i, (_, b) in enumerate(toks)}
        gold = {(starts.get(s, -1), ends.get(e, -1), k) for k, s, e in spans}
        right = sorted((x for x in segs if x[:3] in gold), key=lambda x: x[0])
        if len(right) != len(spans):
            continue
        counts: dict[str, float] = {}
        before, at = "O", 0
        for i, j, k, f in [*right, (len(toks), len(toks), "", [])]:
            while at < i:
                counts[f"after:{before}>O"] = counts.get(f"after:{before}>O", 0) + 1
                before, at = "O", at + 1
            if k:
                for x in [*f, f"after:{before}>{k}"]:
                    counts[x] = counts.get(x, 0) + 1
                before, at = k, j
        batch.append((len(toks), segs, counts))
    squares: dict[str, float] = {}
    for _ in range(epochs):
        gradient: dict[str, float] = {}
        for n, segs, counts in batch:
            for x, p in field.expected(n, segs)[0].items():
                gradient[x] = gradient.get(x, 0.0) - p
            for x, c in counts.items():
                gradient[x] = gradient.get(x, 0.0) + c
        gradient.pop("after:O>O", None)  # stays 0: text outside entities weighs nothing, so a span's score doesn't depend on its length in tokens
        for x, g in gradient.items():
            g -= DECAY * len(batch) * field.w.get(x, 0.0)
            squares[x] = squares.get(x, 1e-8) + g * g
            field.w[x] = field.w.get(x, 0.0) + STEP * g / squares[x] ** 0.5
    return field


def find(text: str, field: SemiMarkov) -> list[tuple[str, int, int, bool]]:
    """All spans of a text as (kind, start, end, whether a base span), ordered."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    taken: list[list[int]] = []  # merged base spans
    for _, start, end in base:
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])

    def free(kind: str, start: int, end: int) -> bool:
        """No base span overlaps; a key may hold whole ones, such as digits in it that pass for a card's."""
        i = bisect_left(taken, end, key=lambda t: t[0]) - 1
        if i < 0 or taken[i][1] <= start:
            return True
        first = bisect_left(taken, start, key=lambda t: t[1] - 1)
        return kind == "secret" and taken[i][1] <= end and taken[first][0] >= start

    for a, b in windows(text):
        toks = tokens(text, a, b)
        segs = [x for x in candidates(text, toks) if free(x[2], toks[x[0]][0], toks[x[1] - 1][1])]
        if segs:
            for i, j, k in field.best(len(toks), segs):
                out.append((k, toks[i][0], toks[j - 1][1], False))
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first one, as in [EMAIL]."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i][:3]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("base", "boolean"))


def detect(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of df named in keep (default: doc_id), spans, and the redacted text (null where the text is)."""
    keep = [doc_id] if keep is None else keep
    names = [f"__k{i}" for i in range(len(keep))]
    rows = df.select(F.col(text).alias("__text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = rows.select(*names).schema.add("spans", SPANS).add("redacted", "string")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    weights = trained().w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("pii")
        field = SemiMarkov()
        field.w = weights
        for batch in batches:
            for part, texts in blocks(batch, 0):
                null = part.column(0).is_null().to_pylist()
                found = [find(t, field) if t else [] for t in texts]
                spans = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in f] for f in found]
                clean = [None if n else (redacted(t, f) if f else t) for n, t, f in zip(null, texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i + 1) for i in range(len(names))), pa.array(spans, kind), pa.array(clean, pa.string())], names=[f.name for f in schema])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "spans", "redacted")
