"""Styled layer descriptors and OGC filters, from XML to the style tree; namespaces and versions don't matter."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from . import filters
from .style import Rule, Style, Symbol, hex_colour

#: The deepest filter, the comparison elements, and the most a size may be.
DEEPEST = 64
COMPARISONS = {"PropertyIsEqualTo": "=", "PropertyIsNotEqualTo": "<>", "PropertyIsLessThan": "<", "PropertyIsGreaterThan": ">", "PropertyIsLessThanOrEqualTo": "<=", "PropertyIsGreaterThanOrEqualTo": ">="}
MOST = 10_000.0


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def children(e: ET.Element, *names: str) -> list[ET.Element]:
    return [c for c in e if not names or name(c) in names]


def first(e: ET.Element | None, *path: str) -> ET.Element | None:
    for p in path:
        e = next(iter(children(e, p)), None) if e is not None else None
    return e


def text(e: ET.Element | None) -> str | None:
    return "".join(e.itertext()).strip() if e is not None else None


class BadFilter(ValueError):
    """A filter that can't be read; its rule then matches every feature."""


def like_pattern(pattern: str, many: str, one: str, escape: str) -> str:
    """A document's pattern with its own wildcards as %, _ and backslash; runs of % are one."""
    out, i = "", 0
    while i < len(pattern):
        if escape and pattern.startswith(escape, i) and i + len(escape) < len(pattern):
            i += len(escape)
            out += ("\\" if pattern[i] in "%_\\" else "") + pattern[i]
            i += 1
        elif many and pattern.startswith(many, i):
            out += "" if out.endswith("%") and not out.endswith("\\%") else "%"
            i += len(many)
        elif one and pattern.startswith(one, i):
            out += "_"
            i += len(one)
        else:
            out += ("\\" if pattern[i] in "%_\\" else "") + pattern[i]
            i += 1
    return out


def read_filter(e: ET.Element, depth: int = 0):
    """A filter element's tree; any part that can't be read makes the whole fail."""
    if depth > DEEPEST:
        raise BadFilter("the filter is too deep")
    kind = name(e)
    if kind == "Filter":
        inner = children(e)
        if len(inner) != 1:
            raise BadFilter("a filter holds one condition")
        return read_filter(inner[0], depth + 1)
    if kind in ("And", "Or"):
        parts = tuple(read_filter(c, depth + 1) for c in e)
        return (filters.And if kind == "And" else filters.Or)(parts)
    if kind == "Not":
        inner = children(e)
        if len(inner) != 1:
            raise BadFilter("Not holds one condition")
        return filters.Not(read_filter(inner[0], depth + 1))
    field = text(next(iter(children(e, "PropertyName", "ValueReference")), None))
    if not field:
        raise BadFilter("no property")
    literals = [text(c) or "" for c in children(e, "Literal")]
    if kind in COMPARISONS and len(literals) == 1:
        return filters.Compare(field, COMPARISONS[kind], literals[0])
    if kind == "PropertyIsBetween":
        bound = lambda n: text(first(e, n, "Literal")) or text(first(e, n))
        low, high = bound("LowerBoundary"), bound("UpperBoundary")
        if low is None or high is None:
            raise BadFilter("a bound is missing")
        return filters.Between(field, low, high)
    if kind == "PropertyIsLike" and len(literals) == 1:
        get = lambda *ks: next((e.get(k) for k in ks if e.get(k) is not None), None)
        return filters.Like(field, like_pattern(literals[0], get("wildCard") or "*", get("singleChar") or "?", get("escapeChar", "escape") or "\\"))
    if kind == "PropertyIsNull":
        return filters.IsNull(field)
    raise BadFilter(f"can't read {kind}")


def _parameters(e: ET.Element | None) -> dict[str, str]:
    return {c.get("name", ""): text(c) or "" for c in children(e, "CssParameter", "SvgParameter")} if e is not None else {}


def _colour(e: ET.Element | None, key: str, default: str):
    if e is None:
        return None
    p = _parameters(e)
    try:
        return hex_colour(p.get(key, default), float(p.get(f"{key}-opacity", 1)))
    except ValueError:
        return hex_colour(default)


def _size(v: str | None, default: float) -> float:
    try:
        return min(MOST, max(0.0, float(v))) if v else default
    except ValueError:
        return default


def _symbol(e: ET.Element) -> Symbol | None:
    kind = name(e)
    if kind == "PolygonSymbolizer":
        stroke = first(e, "Stroke")
        return Symbol("polygon", _colour(first(e, "Fill"), "fill", "#808080"), _colour(stroke, "stroke", "#000000"), width=_size(_parameters(stroke).get("stroke-width"), 1.0))
    if kind == "LineSymbolizer":
        stroke = first(e, "Stroke")
        return Symbol("line", None, _colour(stroke, "stroke", "#000000"), width=_size(_parameters(stroke).get("stroke-width"), 1.0))
    if kind == "PointSymbolizer":
        mark = first(e, "Graphic", "Mark")
        stroke = first(mark, "Stroke")
        return Symbol("point", _colour(first(mark, "Fill"), "fill", "#808080"), _colour(stroke, "stroke", "#000000"), size=_size(text(first(e, "Graphic", "Size")), 6.0), width=_size(_parameters(stroke).get("stroke-width"), 1.0))
    if kind == "TextSymbolizer":
        parts = []
        label = first(e, "Label")
        if label is not None:
            if label.text and label.text.strip():
                parts.append(("text", label.text.strip()))
            for c in label:
                parts.append(("field" if name(c) in ("PropertyName", "ValueReference") else "text", text(c) or ""))
                if c.tail and c.tail.strip():
                    parts.append(("text", c.tail.strip()))
        halo = first(e, "Halo")
        font = _parameters(first(e, "Font"))
        rank = text(first(e, "Priority", "PropertyName")) or text(first(e, "Priority"))
        return Symbol("text", _colour(first(e, "Fill"), "fill", "#000000") or (0, 0, 0, 255), label=tuple(parts), halo=_colour(first(halo, "Fill"), "fill", "#ffffff") or ((255, 255, 255, 255) if halo is not None else None), halo_radius=_size(text(first(halo, "Radius")), 1.0) if halo is not None else 0.0, font_size=_size(font.get("font-size"), 10.0), priority=rank)
    return None


def parse(document: str) -> Style:
    """The first named or user style of a document."""
    root = ET.fromstring(document)
    layers = []
    for fts in [e for e in root.iter() if name(e) == "FeatureTypeStyle"]:
        rules = []
        for r in children(fts, "Rule"):
            f, tree = first(r, "Filter"), None
            if f is not None:
                try:
                    tree = read_filter(f)
                except BadFilter:
                    tree = None
            scale = lambda n, r=r: float(text(first(r, n))) if text(first(r, n)) else None
            rules.append(Rule(text(first(r, "Title")) or text(first(r, "Description", "Title")) or text(first(r, "Name")) or "", tree, first(r, "ElseFilter") is not None, scale("MinScaleDenominator"), scale("MaxScaleDenominator"), tuple(s for c in r if (s := _symbol(c)))))
        layers.append(tuple(rules))
    return Style(tuple(layers))


def looks_like(document: str) -> bool:
    """Whether a style text is XML of this kind and not JSON."""
    return document.lstrip("﻿ \t\r\n").startswith("<") and "StyledLayerDescriptor" in document
