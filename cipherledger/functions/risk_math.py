"""Risk arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import tables as T


def shortfall(x: Column, y: Column, z: Column, now: int) -> Column:
    """Years by which protection and migration overrun the quantum year; x and y count as 0 if negative."""
    at_least_0 = lambda c: F.greatest(c.cast("int"), F.lit(0))
    return (at_least_0(x) + at_least_0(y) - (z.cast("int") - F.lit(now))).cast("int")


def act_now(short: Column) -> Column:
    return short > 0


def deadline(x: Column, y: Column, z: Column) -> Column:
    return (z - x - y).cast("int")


def severity(threat: Column, urgent: Column) -> Column:
    broken = threat.isin("shor_broken", "legacy_broken")
    return F.when(broken & urgent, "critical").when(broken, "high").when(threat.isin("grover_weakened", "unknown"), "low").otherwise("none")


def looked_up(c: Column, table: dict, default) -> Column:
    """A fixed table as one literal, so that the key is one expression, however many rows the table has."""
    known = F.create_map(*(F.lit(v) for pair in table.items() for v in pair))
    return F.coalesce(known[c], F.lit(default))


def rank(sev: Column, unknown: int = -1) -> Column:
    return looked_up(F.lower(sev), T.SEVERITIES, unknown)


def score(threat: Column, x: Column, y: Column, short: Column, weight: Column, sev: Column) -> Column:
    """100 * base * (0.7 + 0.3 * urgency) * criticality to two places; at most 5 where the severity is none."""
    base = looked_up(threat, {"shor_broken": 1.0, "legacy_broken": 0.95, "grover_weakened": 0.5, "quantum_safe": 0.05, "pqc": 0.0}, 0.25)
    urgency = F.when(short > 0, F.least(F.lit(1.0), short / F.greatest(F.lit(1), x + y))).otherwise(0.0)
    s = F.round(100 * base * (0.7 + 0.3 * urgency) * weight, 2)
    return F.when(sev == "none", F.least(s, F.lit(5.0))).otherwise(s)


def label(weight: Column) -> Column:
    """The criticality label nearest to a weight; the higher of two equally near."""
    at = F.array(*[F.struct(F.round(F.abs(weight - w), 9).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, w) in enumerate(T.LABELS)])
    return F.array_min(at)["n"]


def label_weight(name: Column) -> Column:
    return looked_up(name, dict(T.LABELS), 0.5)
