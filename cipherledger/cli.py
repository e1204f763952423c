"""Command line: scan, report, ci and history.

    python -m cipherledger.cli scan PATH [--policy F] [--json F] [--cbom F] [--sarif F] [--report F] [--db DIR]
    python -m cipherledger.cli ci PATH [--fail-on SEVERITY]
    python -m cipherledger.cli history DIR
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import emit, gate, history, risk
from .plans import inventory
from .plans import scan as plan
from .plans.policy_file import Policy


def _session() -> SparkSession:
    return SparkSession.builder.appName("cipherledger").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cipherledger")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "report", "ci"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--exclude", action="append", default=[])
        s.add_argument("--policy")
        s.add_argument("--now", type=int, default=datetime.now(timezone.utc).year)
        for out in ("json", "cbom", "sarif", "report", "db"):
            s.add_argument(f"--{out}")
        s.add_argument("--fail-on", default="critical", choices=["critical", "high", "medium", "low", "none", "off"])
    h = sub.add_parser("history")
    h.add_argument("path")
    a = p.parse_args(argv)
    spark = _session()
    if a.command == "history":
        past = history.load(spark, a.path)
        if past is None:
            print("no scans")
            return 0
        history.scans(past).orderBy("scan_id").show(truncate=False)
        two = [r[0] for r in history.latest(past).collect()]
        if len(two) == 2:
            history.posture(past, *two).show(truncate=False)
        return 0
    rules = Policy.load(a.policy)
    done = plan.of_tree(spark, a.path, a.exclude, now=a.now, rules=rules)
    assets = done.assets.cache()
    errors = [f"{r.source}: {r.message}" for r in done.errors.limit(50).collect()]
    for c in risk.severity_counts(assets).orderBy("severity_rank", ascending=False).collect():
        print(f"{c.severity:>9} {c.n}")
    if a.json:
        Path(a.json).write_text("[" + ",\n".join(assets.drop("weight").toJSON().toLocalIterator()) + "]\n")
    if a.cbom:
        Path(a.cbom).write_text(emit.cbom(inventory.with_occurrences(assets, done.places), a.path))
    if a.sarif:
        Path(a.sarif).write_text(emit.sarif(assets, done.places))
    text = emit.report(assets, a.path, errors)
    if a.report:
        Path(a.report).write_text(text)
    elif a.command == "report":
        print(text)
    if a.db:
        stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
        history.save(assets, a.db, stamp, a.path, stamp)
    if a.command != "ci":
        return 0
    fail_on = None if a.fail_on == "off" else a.fail_on
    flags = gate.flagged(assets, fail_on, rules.floor, rules.mosca_blocks, rules.ignore, done.places)
    today = datetime.now(timezone.utc).strftime("%Y-%m-%d")
    judged = gate.waived(flags, rules.waiver_rows(spark), today, done.places).cache()
    v = gate.verdict(judged, rules.budgets, fail_on is not None, len(errors), rules.errors_block).first().asDict()
    print(gate.summary(v, [r.asDict() for r in gate.offenders(judged).collect()], fail_on, errors[:5]))
    return v["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
