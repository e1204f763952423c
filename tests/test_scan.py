"""A tree from end to end, sinks, history and the entry points."""

import json

from cipherledger import queries
from cipherledger.operators import emit, gate, history
from cipherledger.plans import inventory, scan


def test_tree(spark, tmp_path):
    for p, t in queries.CORPUS.items():
        f = tmp_path / "tree" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    (tmp_path / "tree/bad.py").write_text("def (")
    s = scan.of_tree(spark, str(tmp_path / "tree"), now=2026)
    assets = s.assets.cache()
    rows = assets.collect()
    assert len(rows) >= 5 and all(r.n_occ > 0 for r in rows)
    assert s.places.where("file like '%node_modules%'").count() == 0
    assert any("bad.py" in r.source for r in s.errors.collect())
    assert len({r.asset_key for r in rows}) == len(rows)
    assert all(0 <= r.score <= 100 for r in rows)
    cbom = json.loads(emit.cbom(inventory.with_occurrences(assets, s.places), "tree"))
    assert cbom["bomFormat"] == "CycloneDX" and any("cryptoProperties" in c for c in cbom["components"])
    sarif = json.loads(emit.sarif(assets, s.places))
    assert sarif["version"] == "2.1.0" and all(r["locations"][0]["physicalLocation"]["region"]["startLine"] >= 1 for r in sarif["runs"][0]["results"])
    assert len(emit.report(assets, "tree", ["one"])) > 100
    assert gate.flagged(assets, "none").where("blocking").count() == len(rows)
    assert gate.flagged(assets, None).where("blocking").count() == 0
    out = str(tmp_path / "history")
    history.save(assets, out, "1", "t", "a")
    history.save(assets.where("family <> 'MD5'"), out, "2", "t", "b")
    past = history.load(spark, out)
    d = {r.status for r in history.diff(past, 1, 1).collect()}
    assert d == {"unchanged"}
    assert {r.status for r in history.diff(past, 1, 2).collect()} == {"unchanged", "removed"}
    assert history.posture(past, 1, 2).first().posture == "improved"
    assert scan.patches(s).where("file = 'payments/pay.js'").count() >= 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_policy_file(spark):
    from cipherledger.plans.policy_file import Policy

    p = Policy.loads("""
mosca: {Z_quantum_threat_year: 2030}
migration: {Y_by_family: {RSA: 7}, default_Y_years: x}
data_classes: {secretish: {X_protection_lifetime: 50}}
data_class_paths: {"**/app/**": secretish, "**/odd/**": nowhere}
business_criticality: {"**/app/**": 3}
ignore: ["**/svc/**"]
gate: {fail_on: none, max_high: 2, waivers: [{family: MD5, reason: r, expires: 2027-01-01}]}
""")
    assert p.quantum_year == 2030 and p.y_by_family["RSA"] == 7 and p.default_y == 3 and p.fail_on is None
    assert p.budgets == {"high": 2} and p.waivers[0][1] == "MD5" and len(p.problems) == 2
    assert dict(p.criticality_rules)["**/app/**"] == 1.0 and p.class_rules[-1] == ("**/odd/**", "default")
    rows = [(k, t.encode(), len(t.encode())) for k, t in queries.CORPUS.items() if k.endswith(".py")]
    s = scan.of_files(spark, spark.createDataFrame(rows, "path string, content binary, length long"), now=2026, rules=p)
    rsa = s.assets.where("family = 'RSA'").first()
    assert (rsa.data_class, rsa.x_years, rsa.y_years, rsa.z_year, rsa.criticality) == ("secretish", 50, 7, 2030, "critical")
    assert Policy().rule_counts()["classes"] > 40
