"""Domain profiles: the dictionary of a graph's kinds as data, and questions put to it as columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVENANCE = {
    "extracted_truth": (), "sourced_fact": ("source", "as_of"), "estimate": ("method", "window", "error"),
    "inference": ("dataset", "method", "support"), "declared_claim": ("claimant",),
}
FORMAT = "graphloom.profile/1"


@dataclass(frozen=True)
class Profile:
    id: str
    node_kinds: tuple[str, ...]
    edge_kinds: tuple[str, ...]  # in the order queries use
    dependency: frozenset
    breakage: frozenset
    closure: tuple[str, ...]  # in the order diagnostics use
    containment: frozenset = frozenset({"contains"})
    symmetric: frozenset = frozenset()
    boundary_kind: str = "external"
    boundary_prefix: str = "external::"
    resolve_rank: dict = field(default_factory=dict)
    tiers: dict = field(default_factory=dict)
    classes: dict = field(default_factory=dict)  # edge kind -> provenance class
    attrs: dict = field(default_factory=dict)  # edge kind -> allowed attribute names

    def is_in(self, name: str, kind: Column | str = "kind") -> Column:
        """dependency, breakage, closure, containment or symmetric."""
        kind = F.col(kind) if isinstance(kind, str) else kind
        return kind.isin(sorted(getattr(self, name)))

    def is_boundary(self, kind: Column, id: Column) -> Column:
        return (kind == self.boundary_kind) | id.startswith(self.boundary_prefix)

    def package_of(self, id: Column) -> Column:
        """The first segment of an id; null for boundary ids."""
        return F.when(~id.startswith(self.boundary_prefix), F.substring_index(id, "::", 1))

    def edge_rank(self, kind: Column) -> Column:
        return F.coalesce(F.array_position(F.array(*map(F.lit, self.edge_kinds)), kind).cast("int"), F.lit(0))

    def rank_of(self, kind: Column) -> Column:
        return _cases(kind, self.resolve_rank, F.lit(2))

    def tier_of(self, kind: Column) -> Column:
        return _cases(kind, self.tiers, F.lit("optional"))

    def required(self, kind: str) -> tuple[str, ...]:
        return PROVENANCE[self.classes.get(kind, "extracted_truth")]

    def provenance_class(self, kind: Column) -> Column:
        return _cases(kind, {k: self.classes.get(k, "extracted_truth") for k in self.edge_kinds}, F.lit("undeclared"))

    def allowed(self, kind: str) -> tuple[str, ...]:
        return tuple(self.attrs.get(kind, ())) + self.required(kind)


def _cases(kind: Column, table: dict, default: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(kind == k, F.lit(v)) if out is None else out.when(kind == k, F.lit(v))
    return default if out is None else out.otherwise(default)


def load(text: str) -> Profile:
    """A profile from JSON; anything unknown or inconsistent is refused by name."""
    raw = json.loads(text)
    if raw.pop("format", None) != FORMAT:
        raise ValueError(f"profile format is not {FORMAT}")
    extra = set(raw) - set(Profile.__dataclass_fields__)
    if extra:
        raise ValueError(f"unknown profile fields: {sorted(extra)}")
    for k in ("node_kinds", "edge_kinds", "closure"):
        raw[k] = tuple(raw.get(k, ()))
    for k in ("dependency", "breakage", "containment", "symmetric"):
        raw[k] = frozenset(raw.get(k, ()))
    p = Profile(**raw)
    for name in ("dependency", "breakage", "closure", "containment", "symmetric"):
        if unknown := set(getattr(p, name)) - set(p.edge_kinds):
            raise ValueError(f"{name} names unknown edge kinds: {sorted(unknown)}")
    if unknown := set(p.classes.values()) - set(PROVENANCE):
        raise ValueError(f"unknown provenance classes: {sorted(unknown)}")
    if p.boundary_kind not in p.node_kinds:
        raise ValueError(f"boundary kind {p.boundary_kind} is no node kind")
    return p


def _split(text: str) -> tuple[str, ...]:
    return tuple(text.split())


_CODE = _split("imports calls inherits implements defines references contains reads writes")
CODE = Profile(
    "code", _split("package module file class interface function method variable external doc"), _CODE,
    dependency=frozenset(_CODE) - {"contains"}, breakage=frozenset(_split("calls inherits implements reads writes")), closure=("calls", "imports"),
    resolve_rank=dict.fromkeys(_split("class interface function method variable"), 0) | dict.fromkeys(_split("package module file"), 1),
    tiers=dict.fromkeys(_split("package module file"), "core") | dict.fromkeys(_split("class interface"), "recommended"),
    attrs={"imports": ("bindings",)},
)
_GRAMMAR = _split("subject object modifies attaches-to precedes coordinated-with refers-to")
_CLAIMS = _split("supports contradicts causes same-entity")
ENGLISH = Profile(
    "english", _split("document sentence predicate entity external"), ("contains", *_GRAMMAR, *_CLAIMS),
    dependency=frozenset(_GRAMMAR + _CLAIMS), breakage=frozenset(_CLAIMS), closure=("coordinated-with", *_CLAIMS), symmetric=frozenset({"same-entity"}),
    classes=dict.fromkeys(_CLAIMS, "declared_claim"),
)
_RA = _split("contains computes_into articulates assumes sourced_from estimates references")
RA = Profile(
    "ra", _split("model statement line_item driver parameter period scenario output source"), _RA,
    dependency=frozenset(_RA) - {"contains"}, breakage=frozenset({"computes_into", "articulates"}), closure=("computes_into", "assumes"),
    boundary_kind="source", boundary_prefix="source::", classes={"sourced_from": "sourced_fact", "estimates": "estimate", "references": "declared_claim"},
)
PROFILES = {p.id: p for p in (CODE, ENGLISH, RA)}


def embedded(id: str) -> Profile:
    if id not in PROFILES:
        raise KeyError(f"unknown profile: {id}")
    return PROFILES[id]
