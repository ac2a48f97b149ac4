"""The rule object: what to check, on which entity, how strictly."""
from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Rule:
    rule_id: str
    entity: str
    check: dict[str, Any]
    columns: tuple[str, ...] = ()
    name: str = ""
    category: str = "data_quality"
    dimension: str = "validity"
    scope: str = "column"
    filter: str | None = None
    severity: str = "medium"
    tolerance: float = 0.0
    rationale: str | None = None
    origin: str = "steward"
    evidence: tuple[str, ...] = field(default_factory=tuple)

    @property
    def type(self) -> str:
        return self.check["type"]

    def param(self, name: str, default: Any = None) -> Any:
        value = self.check.get(name)
        return default if value is None else value

    @property
    def limit(self) -> float:
        """The failure rate up to which the rule still passes."""
        return self.check.get("max_rate", -1.0) if self.type == "null_rate_max" else self.tolerance

    def to_json(self) -> str:
        return json.dumps({
            "name": self.name, "category": self.category, "dimension": self.dimension, "scope": self.scope,
            "target": {"entity": self.entity, "columns": list(self.columns)}, "check": self.check,
            "filter": self.filter, "severity": self.severity, "tolerance": self.tolerance,
            "rationale": self.rationale, "evidence": list(self.evidence), "origin": self.origin})

    @staticmethod
    def from_json(rule_id: str, text: str) -> "Rule":
        d = json.loads(text)
        target = d.get("target") or {}
        return Rule(
            rule_id=rule_id, entity=target.get("entity"), columns=tuple(target.get("columns") or ()),
            check=d["check"], name=d.get("name") or "", category=d.get("category") or "data_quality",
            dimension=d.get("dimension") or "validity", scope=d.get("scope") or "column", filter=d.get("filter"),
            severity=d.get("severity") or "medium", tolerance=d.get("tolerance") or 0.0,
            rationale=d.get("rationale"), origin=d.get("origin") or "steward",
            evidence=tuple(d.get("evidence") or ()))
