"""Settings of a build: the keyword defaults of the functions that it runs, and what a user sets otherwise.

A group stands for one function; its settings are that function's scalar keyword defaults, so each default is written once,
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from tidemark.operators import graph, pools, relation, stats, vectors
from tidemark.sources import sinks

GROUPS: dict[str, Callable] = {
    "relation": relation.post_tags,
    "shards": sinks.write_post_tags,
    "collection-shards": sinks.write_pool_posts,
    "ancestors": graph.ancestor_cache,
    "idf": stats.tag_stats,
    "pairs": stats.tag_pmi,
    "ranking": stats.topk_posts,
    "collections": pools.parse_pools,
    "eligible": pools.eligible_pools,
    "together": pools.pool_tag_co,
    "universe": vectors.tag_universe,
    "edges": vectors.tag_graph,
    "weights": vectors.ppmi,
    "embedding": vectors.tag2vec,
    "neighbours": vectors.knn,
}


def defaults(group: str) -> dict[str, object]:
    found = inspect.signature(GROUPS[group]).parameters.values()
    return {p.name: p.default for p in found if isinstance(p.default, bool | int | float | str)}


def _parsed(text: str, like: object) -> object:
    if isinstance(like, bool):
        if text.lower() not in ("true", "false"):
            raise ValueError(f"{text!r} is neither true nor false")
        return text.lower() == "true"
    return type(like)(text)


@dataclass(frozen=True)
class Settings:
    """root: the folder of dumps and datasets.  reliable_only holds for every group that has it; given: 'group.name' to value."""

    root: str = "data"
    force: bool = False
    reliable_only: bool = True
    given: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        known = {f"{g}.{n}" for g in GROUPS for n in defaults(g)}
        if unknown := set(self.given) - known:
            raise ValueError(f"no settings {sorted(unknown)}; there are {sorted(known)}")

    def of(self, group: str) -> dict[str, object]:
        out = defaults(group)
        if "reliable_only" in out:
            out["reliable_only"] = self.reliable_only
        for name, default in out.items():
            value = self.given.get(f"{group}.{name}", default)
            out[name] = _parsed(value, default) if isinstance(value, str) else value
        return out

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"
