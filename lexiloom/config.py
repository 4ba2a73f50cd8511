"""Settings of retrieval, reranking and verification. Thresholds were fitted to one corpus; fit them anew for another."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Retrieval:
    max_df_share: float = 0.03
    max_df_least: int = 50
    field_cap: int = 6  #: module and type postings may be so many times larger
    coverage: float = 0.2474
    margin: float = 0.2671
    expansions: int = 8
    expansion_weight: float = 0.85
    stem_weight: float = 0.95
    prefix_weight: float = 0.85
    module_weight: float = 0.1
    type_weight: float = 0.15
    title_weight: float = 2.5
    length_pivot: float = 0.75
    tail: int = 10


@dataclass(frozen=True)
class Reranking:
    weight: float = 0.9
    gate: float = 0.45
    depth: int = 10_000
    relation_penalty: float = 0.3
    root_penalty: float = 0.4


@dataclass(frozen=True)
class Verification:
    absolute: float = 0.05
    relative: float = 0.35
    pattern: float = 0.25
    module_weight: float = 0.3
    rivals: int = 8


#: Verification thresholds by how much a wrong acceptance costs.
PROFILES = {
    "precise": Verification(0.0946, 1.0),
    "balanced": Verification(0.0451, 0.9268),
    "permissive": Verification(0.0554, 0.7059),
}
#: Thresholds for claims of a paper's graph.
GRAPH = Retrieval(coverage=0.2526, margin=0.2658)
