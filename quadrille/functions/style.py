"""Styles: raster ramps and band picks, vector rules, labels and priorities; compiled to Columns."""

from __future__ import annotations

import functools
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import filters


def half_away(x: float) -> int:
    """Rounded half away from zero."""
    return int(x + 0.5) if x >= 0 else -int(0.5 - x)


# Raster styles.


@dataclass(frozen=True)
class Bands:
    """Red, green and blue by 1-based band number."""

    red: int = 1
    green: int = 2
    blue: int = 3


@dataclass(frozen=True)
class Ramp:
    """Pseudocolour: (value, (r, g, b, a)) stops by rising value."""

    stops: tuple
    band: int = 1


def raster_style(text: str) -> Bands | Ramp:
    """A raster style from JSON: {"type": "rgb", ...} or {"type": "pseudocolor", "stops": [[v, r, g, b(, a)], ...]}."""
    doc = json.loads(text)
    kind = doc.get("type", "pseudocolor" if "stops" in doc else "rgb")
    if kind == "rgb":
        return Bands(*(int(doc.get(k, i + 1)) for i, k in enumerate(("red", "green", "blue"))))
    if kind != "pseudocolor":
        raise ValueError(f"unknown raster style {kind!r}")
    stops = []
    for s in doc["stops"]:
        if len(s) not in (4, 5):
            raise ValueError("a stop has four or five numbers")
        stops.append((float(s[0]), (*(min(255, max(0, half_away(float(c)))) for c in s[1:]), *([255] if len(s) == 4 else []))))
    if not stops:
        raise ValueError("a ramp needs stops")
    return Ramp(tuple(sorted(stops, key=lambda s: s[0])), int(doc.get("band", 1)))


def ramp_colour(ramp: Ramp, x: float) -> tuple[int, int, int, int]:
    """Colour of a value: held at the ends, linear between stops, rounded half away."""
    stops = ramp.stops
    if x <= stops[0][0]:
        return stops[0][1]
    for (a, c), (b, d) in zip(stops, stops[1:]):
        if x <= b:
            t = (x - a) / (b - a) if b > a else 1.0
            return tuple(min(255, max(0, half_away(p + (q - p) * t))) for p, q in zip(c, d))
    return stops[-1][1]


def ramp_column(ramp: Ramp, x: Column, channel: int) -> Column:
    """One channel (0 to 3) of the ramp's colour of a value; 0 for null and values that aren't finite."""
    stops = ramp.stops
    x = x.cast("double")
    out = F.lit(stops[-1][1][channel])
    for (a, c), (b, d) in reversed(list(zip(stops, stops[1:]))):
        mixed = F.lit(float(c[channel])) + F.lit(float(d[channel] - c[channel])) * ((x - F.lit(a)) / F.lit(b - a)) if b > a else F.lit(float(d[channel]))
        out = F.when(x <= F.lit(b), F.round(mixed).cast("int")).otherwise(out)
    out = F.when(x <= F.lit(stops[0][0]), F.lit(stops[0][1][channel])).otherwise(out)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)), F.lit(0)).otherwise(out)


def over(colour: Column, alpha: Column, background: int) -> Column:
    """A straight-alpha channel flattened on a background; whole numbers, truncated."""
    return F.floor((colour * alpha + F.lit(background) * (F.lit(255) - alpha)) / 255).cast("int")


# Vector styles.


@dataclass(frozen=True)
class Symbol:
    """A symbolizer: kind is point, line, polygon or text; the rest as its kind has it."""

    kind: str
    fill: tuple | None = None
    stroke: tuple | None = None
    size: float = 6.0
    width: float = 1.0
    label: tuple = ()
    halo: tuple | None = None
    halo_radius: float = 0.0
    offset: float = 2.0
    font_size: float = 12.0
    priority: object = None


@dataclass(frozen=True)
class Rule:
    """A rule: its filter (None: all rows), scale range (least <= scale < most), and symbols."""

    name: str = ""
    filter: object = None
    otherwise: bool = False
    least: float | None = None
    most: float | None = None
    symbols: tuple = ()

    def active(self, scale: float) -> bool:
        return (self.least is None or scale >= self.least) and (self.most is None or scale < self.most)


@dataclass(frozen=True)
class Style:
    """Feature type styles, each a sequence of rules; drawn one after another."""

    layers: tuple[tuple[Rule, ...], ...] = field(default_factory=tuple)


def chosen(rules: tuple[Rule, ...], props: dict, scale: float) -> list[int]:
    """Ordinals of the rules that apply to one row: all active ones that match, else the first active else-rule."""
    active = [(i, r) for i, r in enumerate(rules) if r.active(scale)]
    out = [i for i, r in active if not r.otherwise and (r.filter is None or filters.holds(r.filter, props))]
    return out or [i for i, r in active if r.otherwise][:1]


def chosen_column(rules: tuple[Rule, ...], fields: filters.Fields, scale: float | Column) -> Column:
    """The same as an array<int> column; the scale may be a number or a column."""
    if isinstance(scale, Column):
        live = [(F.lit(True) if r.least is None else scale >= r.least) & (F.lit(True) if r.most is None else scale < r.most) for r in rules]
    else:
        live = [F.lit(r.active(scale)) for r in rules]
    plain = [F.when(on & (filters.column(r.filter, fields) if r.filter is not None else F.lit(True)), F.lit(i)) for i, (r, on) in enumerate(zip(rules, live)) if not r.otherwise]
    none = F.array().cast("array<int>")
    matched = F.array_compact(F.array(*plain)) if plain else none
    fallback = functools.reduce(lambda rest, i: F.when(live[i], F.array(F.lit(i))).otherwise(rest), [i for i, r in reversed(list(enumerate(rules))) if r.otherwise], none)
    return F.when(F.size(matched) > 0, matched).otherwise(fallback)


def number_text(x: float) -> str:
    """A number for labels: whole ones below 1e15 without a fraction."""
    return str(int(x)) if x == x and abs(x) < 1e15 and x == int(x) else repr(x)


def label(parts: tuple, props: dict) -> str:
    """A label template's text: (text,) literals and field names as ("field", name); absent fields are empty."""
    out = []
    for kind, value in parts:
        v = value if kind == "text" else props.get(value)
        out.append(number_text(v) if isinstance(v, float) else v or "")
    return "".join(out)


def label_column(parts: tuple, fields: filters.Fields) -> Column:
    """The same as a string column."""

    def one(kind: str, value: str) -> Column:
        if kind == "text":
            return F.lit(value)
        n = fields.num(value)
        shown = F.when((F.abs(n) < 1e15) & (n == F.floor(n)), F.floor(n).cast("long").cast("string")).otherwise(n.cast("string"))
        return F.coalesce(F.when(n.isNotNull(), shown), fields.str(value), F.lit(""))

    return F.concat(*[one(*p) for p in parts]) if parts else F.lit("")


def priority_column(value: float | str | None, higher_first: bool, fields: filters.Fields) -> Column:
    """Sort key of labels, least first: a number or a numeric field; what is missing comes last."""
    key = F.lit(None).cast("double") if value is None else fields.num(value) if isinstance(value, str) else F.lit(float(value))
    return F.coalesce(-key if higher_first else key, F.lit(math.inf))


def decluttered(priority: Column, metres_per_pixel: float) -> Column:
    """Whether a plain style's feature is shown at a resolution: priorities up to the zoom, rounded."""
    return priority <= math.floor(math.log2(156543.03 / metres_per_pixel) + 1 + 0.5)


def class_of(name: str, levels: int) -> Column:
    """The first levels of a dotted class code."""
    return F.substring_index(F.col(name), ".", levels)


def hex_colour(text: str, opacity: float = 1.0) -> tuple[int, int, int, int]:
    """#rgb, #rrggbb or #rrggbbaa with an opacity."""
    h = text.strip().lstrip("#")
    h = "".join(c * 2 for c in h) if len(h) == 3 else h
    if len(h) not in (6, 8):
        raise ValueError(f"bad colour {text!r}")
    v = [int(h[i : i + 2], 16) for i in range(0, len(h), 2)]
    return (*v[:3], min(255, max(0, half_away((v[3] if len(v) == 4 else 255) * min(1.0, max(0.0, opacity))))))


def style_from_json(text: str) -> Style:
    """A plain JSON style: {"rules": [{"filter": .., "min_scale": .., "max_scale": .., "else": .., "symbols": [..]}]} or one symbol."""
    doc = json.loads(text)

    def colour(v):
        return None if v is None else hex_colour(v) if isinstance(v, str) else (*v, *([255] if len(v) == 3 else []))

    def symbol(s: dict) -> Symbol:
        text = s.get("label")
        parts = (("field", text["field"]),) if isinstance(text, dict) else (("text", text),) if text else ()
        return Symbol(s.get("type", "polygon"), colour(s.get("fill")), colour(s.get("stroke")), float(s.get("size", 6)), float(s.get("width", 1)), parts, colour(s.get("halo")), float(s.get("halo_radius", 0)), float(s.get("offset", 2)), float(s.get("font_size", 12)), s.get("priority"))

    def tree(f):
        if f is None:
            return None
        op = f["op"]
        if op in filters.OPERATORS:
            return filters.Compare(f["field"], op, str(f["value"]))
        if op == "between":
            return filters.Between(f["field"], str(f["low"]), str(f["high"]))
        if op == "like":
            return filters.Like(f["field"], f["pattern"])
        if op == "is_null":
            return filters.IsNull(f["field"])
        if op == "not":
            return filters.Not(tree(f["part"]))
        return (filters.And if op == "and" else filters.Or)(tuple(tree(p) for p in f["parts"]))

    rules = doc.get("rules") or [{"symbols": [doc]}]
    return Style((tuple(Rule(r.get("name", ""), tree(r.get("filter")), bool(r.get("else")), r.get("min_scale"), r.get("max_scale"), tuple(symbol(s) for s in r.get("symbols", []))) for r in rules),))


def referenced(style: Style) -> list[str]:
    """Attributes that a style's filters, labels and priorities read."""
    out: list[str] = []
    for rules in style.layers:
        for r in rules:
            out += filters.fields_of(r.filter) if r.filter is not None else []
            for s in r.symbols:
                out += [v for k, v in s.label if k == "field"] + ([s.priority] if isinstance(s.priority, str) else [])
    return list(dict.fromkeys(out))
