"""Layers, relations and the choice of each layer's matching method. Planning sees tens of rows, no table data."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.functions.geometry import NAMED, TRANSFORMATIONS
from zonepack.functions.text import FALSE_TOKENS, TRUE_TOKENS
from zonepack.operators.graph import path_lists
from zonepack.operators.membership import Hop

METHODS = ("auto", "attribute", "spatial", "whole_export")
BOX = ("minx", "miny", "maxx", "maxy")


class PlanError(ValueError):
    """Everything that is wrong with a catalog, reported together."""


@dataclass(frozen=True)
class Relation:
    id: str
    child: str
    parent: str
    pairs: tuple[tuple[str, str], ...]
    valid: bool = True
    kind: str = "normal"


@dataclass(frozen=True)
class Layer:
    """``geometry`` is none, point, line or polygon; boxes are read from columns minx, miny, maxx, maxy.
    ``shape`` names a column with the edges (array of struct x1, y1, x2, y2, and part where there are several) of lines
    and polygons that are more than their boxes. ``boxed`` says that lines are the segments from the lower left to the
    upper right corners of their boxes; without it they need a shape. ``srid`` is the coordinate system.
    ``computed`` are further fields of the packages, SQL expressions by name over the fields that are kept and stratum_id:
    they are evaluated for the rows of a stratum, so one that fails does so for its strata only."""

    id: str
    source: DataFrame
    fid: tuple[str, ...]
    subset: str | None = None
    matching_method: str = "auto"
    spatial_predicate: str = "auto"
    relation_path: str | None = None
    excluded_fields: tuple[str, ...] = ()
    exclude: str | bool | None = None
    warm: bool = False
    geometry: str = "none"
    shape: str | None = None
    boxed: bool = False
    srid: int | None = None
    source_key: str | None = None
    layer_name: str | None = None
    computed: Mapping[str, str] = field(default_factory=dict)

    @property
    def rows(self) -> DataFrame:
        return self.source.where(F.expr(self.subset)) if self.subset else self.source


@dataclass(frozen=True)
class Plan:
    layer: Layer
    method: str
    relation_ids: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    pinned: bool = False


def strict_bool(raw: str | bool | None) -> bool:
    if raw is None or isinstance(raw, bool):
        return bool(raw)
    token = raw.strip().lower()
    if token not in TRUE_TOKENS + FALSE_TOKENS:
        raise PlanError(f"{raw!r} is neither true nor false")
    return token in TRUE_TOKENS


def string_list(raw: str | None, what: str) -> list[str] | None:
    """A JSON list of strings, or an error."""
    if raw is None:
        return None
    try:
        found = json.loads(raw)
    except ValueError:
        found = None
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise PlanError(f"{what} is not a JSON list of strings: {raw}")
    return found


def auto_predicates(feature: str, stratum: str) -> tuple[str, ...]:
    """Default predicates by geometry class: shared interiors where either side has an area."""
    if "point" in (feature, stratum) or feature == stratum == "line":
        return ("intersects",)
    if feature == stratum:
        return ("T********",)
    return ("T********", "*1*******") if feature == "line" else ("T********", "***1*****")


def predicate_tokens(raw: str, feature: str, stratum: str) -> tuple[str, ...]:
    tokens = list(dict.fromkeys(t for x in raw.split(",") if (t := x.strip())))
    tokens = list(dict.fromkeys(t.lower() if t.lower() in (*NAMED, "auto") else t.upper() for t in tokens)) or ["auto"]
    if "auto" in tokens:
        if len(tokens) > 1:
            raise PlanError("auto stands alone")
        return auto_predicates(feature, stratum)
    if bad := [t for t in tokens if t not in NAMED and not re.fullmatch("[TF012*]{9}", t)]:
        raise PlanError(f"unknown predicates {', '.join(bad)}")
    return tuple(tokens)


@dataclass
class Catalog:
    spark: SparkSession
    layers: dict[str, Layer] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)

    def add(self, layer_id: str, source: DataFrame | str, fid: str | Sequence[str], **flags) -> Catalog:
        df = self.spark.read.parquet(source) if isinstance(source, str) else source
        if not df.schema.fields:
            raise PlanError(f"{layer_id} has no fields")
        self.layers.setdefault(layer_id, Layer(layer_id, df, (fid,) if isinstance(fid, str) else tuple(fid), **flags))
        return self

    def relate(self, relation_id: str, child: str, parent: str, pairs: Sequence[tuple[str, str]], **flags) -> Catalog:
        self.relations[relation_id] = Relation(relation_id, child, parent, tuple(pairs), **flags)
        return self

    def eligible(self) -> list[str]:
        return [i for i, layer in self.layers.items() if not strict_bool(layer.exclude)]

    def usable(self) -> dict[str, Relation]:
        return {i: r for i, r in self.relations.items() if r.valid and r.kind != "generated"}

    def edges(self) -> DataFrame:
        """The relations as an edge table, for the graph operators."""
        rows = [(r.id, r.child, r.parent, r.valid, r.kind) for r in self.relations.values()]
        return self.spark.createDataFrame(rows, "relation_id string, child string, parent string, valid boolean, kind string")

    def paths(self, layer: str, strata: str) -> list[list[str]]:
        return path_lists([(r.id, r.child, r.parent) for r in self.usable().values()], layer, strata)

    def check_pin(self, layer: str, strata: str, ids: Sequence[str]) -> None:
        at, known = layer, self.usable()
        if not ids and layer != strata:
            raise PlanError("the pinned path is empty")
        for i in ids:
            if i not in known:
                raise PlanError(f"unknown relation {i}")
            r = known[i]
            if at not in (r.child, r.parent):
                raise PlanError(f"{i} does not connect to {at}")
            at = r.parent if at == r.child else r.child
        if at != strata:
            raise PlanError(f"the path ends at {at}, not at {strata}")

    def chain(self, layer: str, strata: str, ids: Sequence[str]) -> list[Hop]:
        """Hops from the strata to ``layer``; ``ids`` lead the other way. Each table keeps its own filter."""
        at, tables = layer, []
        for i in ids:
            r = self.relations[i]
            there = r.parent if at == r.child else r.child
            own, other = (0, 1) if at == r.child else (1, 0)
            tables.append((at, tuple(p[own] for p in r.pairs), tuple(p[other] for p in r.pairs)))
            at = there
        return [Hop(near, self.layers[table].rows, far) for table, far, near in reversed(tables)]

    def plan(self, strata: str, layer_ids: Sequence[str] | None = None) -> list[Plan]:
        """The method of each layer: explicit, else by relations, else spatial. All errors in one."""
        plans, errors = [], []
        for i in layer_ids or self.eligible():
            try:
                plans.append(self._plan(self.layers[i], strata))
            except PlanError as e:
                errors.append(f"{i}: {e}")
        if errors:
            raise PlanError("; ".join(errors))
        return plans

    def _plan(self, layer: Layer, strata: str) -> Plan:
        method = layer.matching_method
        if method not in METHODS:
            raise PlanError(f"unknown method {method}")
        if method == "whole_export":
            return Plan(layer, method)
        if layer.id == strata and method in ("auto", "attribute"):
            return Plan(layer, "attribute")
        by_space = layer.geometry != "none" and self.layers[strata].geometry != "none"
        pin = string_list(layer.relation_path, "relation_path")
        if method in ("auto", "attribute"):
            if pin is not None:
                self.check_pin(layer.id, strata, pin)
                return Plan(layer, "attribute", tuple(pin), pinned=True)
            paths = self.paths(layer.id, strata)
            if len(paths) > 1:
                raise PlanError(f"several shortest paths, set relation_path: {'; '.join(' > '.join(p) for p in paths)}")
            if paths:
                return Plan(layer, "attribute", tuple(paths[0]))
            if method == "attribute":
                raise PlanError("no relations lead to the strata")
        if not by_space:
            raise PlanError("neither relations nor geometries lead to the strata")
        whole = self.layers[strata]
        if bare := [x.id for x in (layer, whole) if x.geometry == "line" and not x.shape and not x.boxed]:
            raise PlanError(f"lines without a shape: {', '.join(bare)}")
        if layer.srid and whole.srid and (whole.srid, layer.srid) not in TRANSFORMATIONS and whole.srid != layer.srid:
            raise PlanError(f"no transformation from EPSG:{whole.srid} to EPSG:{layer.srid}")
        return Plan(layer, "spatial", predicates=predicate_tokens(layer.spatial_predicate, layer.geometry, whole.geometry))

    def with_layer(self, layer_id: str, **flags) -> Catalog:
        """A copy of the catalog in which one layer has other flags."""
        return Catalog(self.spark, self.layers | {layer_id: replace(self.layers[layer_id], **flags)}, dict(self.relations))
