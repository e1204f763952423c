"""Policy files: YAML or JSON laid over the defaults, as plain driver objects that the plans turn into expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from .. import tables as T
from ..functions import text as X


@dataclass
class Policy:
    name: str = "default"
    quantum_year: int = T.QUANTUM_YEAR
    default_x: int = 10
    default_y: int = T.DEFAULT_YEARS
    y_by_family: dict = field(default_factory=lambda: dict(T.FAMILY_YEARS))
    classes: dict = field(default_factory=lambda: dict(T.CLASS_YEARS))
    class_rules: list = field(default_factory=lambda: list(T.CLASS_RULES))
    criticality_rules: list = field(default_factory=lambda: list(T.CRITICALITY_RULES))
    ignore: list = field(default_factory=list)
    fail_on: str | None = "critical"
    floor: str = "none"
    mosca_blocks: bool = False
    errors_block: bool = False
    waivers: list = field(default_factory=list)
    budgets: dict = field(default_factory=dict)
    problems: list = field(default_factory=list)

    @classmethod
    def load(cls, path: str | None = None) -> Policy:
        if path is None:
            return cls()
        return cls.loads(Path(path).read_text(), path)

    @classmethod
    def loads(cls, text: str, name: str = "policy") -> Policy:
        try:
            doc = json.loads(text)
        except ValueError:
            import yaml

            doc = yaml.safe_load(text)
        return cls.from_dict(doc or {}, name)

    @classmethod
    def from_dict(cls, doc: dict, name: str = "policy") -> Policy:
        """``doc`` over the defaults: scalars replace, maps overlay and keep the base's key order, lists are united. Values that
        can't be read are left at their default and told in ``problems``."""
        p = cls(name=str(doc.get("name", name)))

        def number(value, old, what, kind=int):
            try:
                return kind(value)
            except (TypeError, ValueError):
                p.problems.append(f"{what}: {value!r} is not a number")
                return old

        mosca, move, gate = (doc.get(k) or {} for k in ("mosca", "migration", "gate"))
        if "Z_quantum_threat_year" in mosca:
            p.quantum_year = number(mosca["Z_quantum_threat_year"], p.quantum_year, "Z_quantum_threat_year")
        if "default_X_protection_years" in mosca:
            p.default_x = p.classes["default"] = number(mosca["default_X_protection_years"], p.default_x, "default_X_protection_years")
        if "default_Y_years" in move:
            p.default_y = number(move["default_Y_years"], p.default_y, "default_Y_years")
        for f, y in (move.get("Y_by_family") or {}).items():
            p.y_by_family[f] = number(y, p.default_y, f"Y_by_family.{f}")
        for c, x in (doc.get("data_classes") or {}).items():
            p.classes[c] = number(x.get("X_protection_lifetime") if isinstance(x, dict) else x, p.default_x, f"data_classes.{c}")
        p.class_rules = _overlaid(p.class_rules, doc.get("data_class_paths"))
        for g, c in p.class_rules:
            if c not in p.classes:
                p.problems.append(f"data_class_paths: {g} names the undeclared class {c}")
        p.class_rules = [(g, c if c in p.classes else "default") for g, c in p.class_rules]
        p.criticality_rules = [(g, min(1.0, max(0.0, number(v, 0.3, f"business_criticality.{g}", float)))) for g, v in _overlaid(p.criticality_rules, doc.get("business_criticality"))]
        p.ignore = list(dict.fromkeys([*p.ignore, *(doc.get("ignore") or [])]))
        for key, own in (("fail_on", "fail_on"), ("min_report_severity", "floor")):
            if key in gate:
                v = str(gate[key]).lower()
                if v in T.SEVERITIES:
                    setattr(p, own, None if (own, v) == ("fail_on", "none") else v)
                else:
                    p.problems.append(f"gate.{key}: unknown severity {v}")
        p.mosca_blocks, p.errors_block = bool(gate.get("fail_on_mosca_act_now", p.mosca_blocks)), bool(gate.get("fail_on_scan_errors", p.errors_block))
        p.budgets = {s: number(gate[f"max_{s}"], 0, f"gate.max_{s}") for s in T.SEVERITIES if f"max_{s}" in gate}
        for i, w in enumerate(gate.get("waivers") or [], 1):
            w = {"family": w} if isinstance(w, str) else dict(w)
            glob = w.get("file") or w.get("path")
            p.waivers.append((i, w.get("family"), w.get("severity"), X.glob_regex(glob) if glob else None, w.get("reason"), None if w.get("expires") is None else str(w["expires"]), w.get("key"), w.get("name")))
        return p

    def waiver_rows(self, spark):
        return spark.createDataFrame(self.waivers, "ord int, family string, severity_is string, file_regex string, reason string, expires string, key string, name string")

    def rule_counts(self) -> dict[str, int]:
        return {"classes": len(self.class_rules), "criticality": len(self.criticality_rules), "ignore": len(self.ignore), "waivers": len(self.waivers)}


def _overlaid(base: list[tuple], more: dict | None) -> list[tuple]:
    out = dict(base)
    out.update(more or {})
    return list(out.items())
