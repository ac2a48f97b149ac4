"""Schema-sized facts the driver holds: entities, their keys, hierarchies. Never rows."""
from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Constraints:
    """Declared keys of a source whose format (parquet) cannot carry them."""
    primary_keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    # (child table, child columns, parent table, parent columns)
    foreign_keys: tuple[tuple[str, tuple[str, ...], str, tuple[str, ...]], ...] = ()
    unique: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def pk(self, table: str) -> tuple[str, ...]:
        return self.primary_keys.get(table, ())


@dataclass(frozen=True)
class Attachment:
    entity: str
    attribute: str
    level: str


@dataclass(frozen=True)
class Hierarchy:
    hierarchy_id: str
    entity: str
    parent: str
    level: str
    levels: tuple[str, ...]
    attached: tuple[Attachment, ...] = ()


@dataclass(frozen=True)
class Entity:
    entity_id: str
    table: str
    primary_key: tuple[str, ...] = ()
    pii: tuple[str, ...] = ()


@dataclass(frozen=True)
class Model:
    entities: dict[str, Entity]
    hierarchies: dict[str, Hierarchy] = field(default_factory=dict)

    def entity(self, entity_id: str) -> Entity:
        if entity_id not in self.entities:
            raise ValueError(f"unknown entity '{entity_id}'")
        return self.entities[entity_id]

    def hierarchy(self, hierarchy_id: str) -> Hierarchy:
        if hierarchy_id not in self.hierarchies:
            raise ValueError(f"unknown hierarchy '{hierarchy_id}'")
        return self.hierarchies[hierarchy_id]


def singular(name: str) -> str:
    name = name.lower()
    for ending, cut, add in (("ies", 3, "y"), ("ses", 2, ""), ("xes", 2, ""), ("ches", 2, ""), ("shes", 2, "")):
        if name.endswith(ending):
            return name[:-cut] + add
    return name[:-1] if re.search(r"[^s]s$", name) or name == "s" else name


def entity_id(table: str) -> str:
    cleaned = re.sub(r"[^a-z0-9_]", "_", singular(table))
    return cleaned if re.match(r"[^\W\d_]", cleaned) else f"t_{cleaned}"


def bare_names(columns: list[str]) -> dict[str, str]:
    """Column -> name without a prefix that every column of the table carries (o_custkey -> custkey)."""
    prefixes = {c.split("_", 1)[0] for c in columns if "_" in c}
    shared = len(columns) > 1 and len(prefixes) == 1 and all("_" in c for c in columns)
    return {c: (c.split("_", 1)[1] if shared else c) for c in columns}
