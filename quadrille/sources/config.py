"""Service configuration: layers, grids and their checks, from JSON (or YAML where a reader is installed)."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlsplit

from ..functions import grids


@dataclass
class LayerConfig:
    """One layer: exactly one of raster and vector, with a style of its kind."""

    name: str
    raster: str | None = None
    vector: str | None = None
    style: str | None = None
    crs: str | None = None
    grids: list[str] = field(default_factory=lambda: ["WebMercatorQuad"])
    expression: str | None = None
    options: dict = field(default_factory=dict)

    def check(self) -> None:
        if (self.raster is None) == (self.vector is None):
            raise ValueError(f"layer {self.name!r}: exactly one of raster and vector")
        if self.raster is not None and self.style is None:
            raise ValueError(f"layer {self.name!r}: a raster needs a style")
        if self.expression and self.vector is not None:
            raise ValueError(f"layer {self.name!r}: an expression needs a raster")


def load(text: str) -> tuple[list[LayerConfig], dict[str, grids.Grid]]:
    """Layers and grids of a configuration text."""
    try:
        doc = json.loads(text)
    except ValueError:
        import yaml

        doc = yaml.safe_load(text)
    own = {g["id"]: grids.from_extent(g["id"], g["crs"], tuple(g["extent"]), g["resolutions"], g.get("tile", 256)) for g in doc.get("grids", [])}
    for g in own.values():
        if not g.invariant():
            raise ValueError(f"grid {g.id!r}: its levels cover different extents")
    layers = [LayerConfig(**x) for x in doc.get("layers", [])]
    if len({x.name for x in layers}) != len(layers):
        raise ValueError("two layers have one name")
    for x in layers:
        x.check()
        for name in x.grids:
            if name not in own:
                own[name] = grids.preset(name)
    return layers, own


@dataclass
class Dsn:
    """A PostGIS address; the password is read from the environment and never shown."""

    host: str
    port: int
    database: str
    user: str
    table: str
    geometry: str
    options: dict

    def jdbc(self) -> tuple[str, dict[str, str]]:
        """URL, and options with the credentials."""
        return f"jdbc:postgresql://{self.host}:{self.port}/{self.database}", {"user": self.user, "password": os.environ.get("PGPASSWORD", "")}

    def __repr__(self) -> str:
        return f"postgis://{self.user}@{self.host}:{self.port}/{self.database}?table={self.table}"


def parse_dsn(uri: str) -> Dsn:
    """postgis://user@host:port/database?table=schema.table&geom=column; a password in it is refused."""
    u = urlsplit(uri)
    if u.scheme.lower() not in ("postgis", "postgres", "postgresql"):
        raise ValueError("not a PostGIS address")
    if u.password is not None:
        raise ValueError("the password belongs into PGPASSWORD, not into the address")
    q = dict(parse_qsl(u.query))
    if not q.get("table") or not u.path.strip("/"):
        raise ValueError("database and table are needed")
    return Dsn(u.hostname or "localhost", u.port or 5432, unquote(u.path.strip("/")), unquote(u.username or ""), q.pop("table"), q.pop("geom", "geom"), q)
