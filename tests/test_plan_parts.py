"""Parts of the plan that look at more than one row: compatible merge, extras, path rules, guesses, moved lines, history."""

import random

import pytest

from cipherledger.operators import history, merge, policy, recommend
from cipherledger.operators.detect import material, run
from cipherledger.plans import inventory
from cipherledger.sources.versions import Conflict, Versioned

FOUND = "family string, name string, kind string, key_size int, curve string, mode string, padding string, file string, line int, confidence string, detector string"


def finding(family, name=None, size=None, mode=None, file="a.py", line=1, confidence="high", curve=None, padding=None, kind="algorithm"):
    return (family, name or family, kind, size, curve, mode, padding, file, line, confidence, "d")


def merged(spark, *rows):
    out = inventory.assets(inventory.compatible(spark.createDataFrame(list(rows), FOUND)))
    return sorted(((r.name, r.key_size, r.mode, r.n_occ) for r in out.collect()), key=str)


def test_compatible_merge_in_the_plan(spark):
    assert merged(spark, finding("Ed25519", size=256), finding("Ed25519", file="b.go")) == [("Ed25519", 256, None, 2)]
    assert merged(spark, finding("RSA", "RSA-1024", 1024), finding("RSA", "RSA-2048", 2048)) == [("RSA-1024", 1024, None, 1), ("RSA-2048", 2048, None, 1)]
    assert merged(spark, finding("RSA", "RSA-1024", 1024), finding("RSA", "RSA-SHA-256", file="b.py")) == [("RSA-1024", 1024, None, 2)]
    assert len(merged(spark, finding("AES", "AES-GCM", mode="GCM"), finding("AES", "AES-ECB", mode="ECB"))) == 2
    assert merged(spark, finding("MD5"), finding("MD5")) == [("MD5", None, None, 1)]
    assert len(merged(spark, finding("RSA", size=2048), finding("RSA", kind="key"))) == 2
    # noise seen with low confidence only takes no part and goes
    assert merged(spark, finding("AES", "AES-128", 128, confidence="low"), finding("AES", mode="GCM", file="b.py")) == [("AES", None, "GCM", 1)]


def test_compatible_merge_as_brute_force_in_any_order(spark):
    r = random.Random(3)
    rows = [finding("AES", r.choice("xyz"), r.choice([None, 128, 256]), r.choice([None, "GCM", "CBC"]), f"{k % 9}.py", k % 4, padding=r.choice([None, "p"])) for k in range(60)]

    def brute():
        sets = sorted({x[1:2] + x[3:4] + x[5:7] for x in rows}, key=lambda s: (-sum(v is not None for v in s[1:]), s[0], [str(s[1]), "None", str(s[2]), str(s[3])]))
        groups = []
        for s in sets:
            for g in groups:
                if all(a is None or b is None or a == b for a, b in zip(s[1:], g[0])):
                    g[0] = tuple(b if b is not None else a for a, b in zip(s[1:], g[0]))
                    g[1].append(s)
                    break
            else:
                groups.append([s[1:], [s]])
        return sorted((g[1][0][0], *g[0], len({(x[7], x[8]) for x in rows if x[1:2] + x[3:4] + x[5:7] in g[1]})) for g in groups)

    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        out = inventory.assets(inventory.compatible(spark.createDataFrame(rows, FOUND).repartition(5)))
        assert sorted(((x.name, x.key_size, x.mode, x.padding, x.n_occ) for x in out.collect()), key=str) == sorted(brute(), key=str)


def test_extras_in_the_plan(spark):
    rows = [(*finding("PBKDF2", file=f"{k}.py"), e) for k, e in enumerate([{"iterations": "700000", "hash": "SHA-1"}, {"iterations": "1000"}, {"iterations": "700000"}, None])]
    rows += [(*finding("JWT", "JWT-none"), {"alg": "none"}), (*finding("TLS1.3", kind="protocol"), {"group": "X25519MLKEM768"})]
    a = {x.family: x for x in inventory.assets(spark.createDataFrame(rows, FOUND + ", extra map<string,string>")).collect()}
    assert a["PBKDF2"].extra == {"iterations": ["1000", "700000"], "hash": ["SHA-1"]}
    assert (a["PBKDF2"].iterations, a["PBKDF2"].threat, a["JWT"].threat, a["TLS1.3"].threat) == (1000, "grover_weakened", "legacy_broken", "pqc")


def test_most_specific_rule(spark):
    rules = [("*", "any"), ("src/*.py", "python"), ("src/**", "src"), ("x.txt", "bare"), ("**/k/*", "deep"), ("s[!r]c/a", "not r"), ("/root/*", "root")]
    want = {"src/a.py": "python", "src/a/b.py": "python", "src/a.c": "src", "q/x.txt": "bare", "./x.txt": "bare", "a/k/b": "deep", "k/b": "deep", "sxc/a": "not r", "src/a": "src", "/root/z": "root", "root/z": "root", "": "any"}
    d = spark.createDataFrame([(k,) for k in want], "p string")
    from pyspark.sql import functions as F

    got = {r.p: r.v for r in d.select("p", policy.most_specific(F.col("p"), rules, "none").alias("v")).collect()}
    assert got == want


def test_guesses_only_where_no_table_knows(spark):
    rows = [("a", 1, "npm", "node-rsa", "1.0"), ("b", 1, "npm", "my-kyber-lib", "1.0"), ("c", 1, "npm", "skyberx", "1"), ("d", 1, "cargo", "pqcrypto", None), ("e", 1, "go", "github.com/cloudflare/circl/kem", "1.0"), ("f", 1, "npm", "Falcon_Kyber", "1")]
    deps = spark.createDataFrame(rows, "file string, line int, ecosystem string, package string, version string")
    got = {r.file: (r.family, r.guessed) for r in run.libraries(deps).collect()}
    assert got == {"a": ("RSA", False), "b": ("ML-KEM", True), "d": ("PQClean", False), "e": ("CIRCL", False), "f": ("ML-DSA", True)}


def test_identifiers():
    assert material.encoded("1.2.840.113549.1.1.1").hex() == "06092a864886f70d010101"
    assert material.encoded("1.3.101.112").hex() == "06032b6570" and material.encoded("2.16.840.1.101.3.4.3.17").hex() == "0609608648016503040311"
    assert material.encoded("1.3.132.0.34").hex() == "06052b81040022" and len(material.SOUGHT) == 32
    for dotted, (family, name, size, curve) in material.SOUGHT.items():
        blob = b"\x00\x30\x10" + material.encoded(dotted) + b"\xff" * 9 + material.encoded(dotted)
        (f,) = material.identifiers(blob)
        assert (f["identifier"], f["family"], f["name"], f["key_size"], f["curve"], f["at"], f["n"]) == (dotted, family, name, size, curve, 3, 2)
    assert material.identifiers(b"+ep and text") == [] and material.identifiers(b"") == []


def test_identifiers_only_where_nothing_else_reads(spark):
    oid = material.encoded("1.3.101.112")
    rows = [("a", b"\x00" + oid), ("b", b"-----BEGIN X-----" + oid), ("c", None), ("d", b""), ("e", b"0\x82" + oid)]
    assert sorted(r.file for r in run.identifiers(spark.createDataFrame(rows, "path string, content binary")).collect()) == ["a", "e"]


def test_moved_lines(spark):
    text = {"a": ["x", "y = hashlib.md5(b)", "z"], "b": ["y = hashlib.md5(b)", "-", "y = hashlib.md5(b)"], "c": ["y = sha256(b)  # y = hashlib.md5(b)"], "d": ["m"]}
    lines = spark.createDataFrame([(f, i, t) for f, ls in text.items() for i, t in enumerate(ls, 1)], "file string, line int, text string")
    sites = [("a", 2, "y = hashlib.md5(b)", "MD5"), ("a", 3, "y = hashlib.md5(b)", "MD5"), ("a", 9, "md5", "MD5"), ("a", 9, "y = hashlib.md5(b)", "RSA"), ("b", 1, "y = hashlib.md5(b)", "MD5"), ("b", 2, "y = hashlib.md5(b)", "MD5"), ("c", 7, "y = hashlib.md5(b)", "MD5"), ("d", 1, None, "MD5"), ("none", 1, "y = hashlib.md5(b)", "MD5")]
    got = recommend.located(spark.createDataFrame(sites, "file string, line int, evidence string, family string"), lines).collect()
    assert sorted(((r.file, r.line, r.family, r.at) for r in got), key=str) == sorted([("a", 2, "MD5", 2), ("a", 3, "MD5", 2), ("a", 9, "MD5", None), ("a", 9, "RSA", None), ("b", 1, "MD5", 1), ("b", 2, "MD5", None), ("c", 7, "MD5", 1), ("d", 1, "MD5", None), ("none", 1, "MD5", None)], key=str)


def test_history_versions(spark, tmp_path):
    home = str(tmp_path / "history")
    assets = spark.createDataFrame([("k1", "RSA", 3, 2), ("k2", "AES", 1, 5)], "asset_key string, family string, severity_rank int, n_occ int")
    assert history.load(spark, home) is None and history.delete(spark, home, "1") is False
    for k in ("1", "2", "3"):
        history.save(assets.where(f"severity_rank <= {k}"), home, k, "t", "now")
    before = history.load(spark, home)
    assert history.delete(spark, home, "2") is True and history.delete(spark, home, "2") is False
    assert {r.scan_id for r in history.load(spark, home).collect()} == {"1", "3"}
    assert before.count() == 4  # a reader of the version before still has it
    store = Versioned(spark, home)
    assert store.parts(3).keys() == {"1", "2", "3"} and store.number() == 4
    with pytest.raises(Conflict):
        store.commit({}, 2)
    # another writer commits in between: the change is made again on what it left
    seen = []

    def edit(parts):
        if not seen:
            seen.append(1)
            Versioned(spark, home).change(lambda p: p | {"9": {"folder": "x"}})
        return {k: v for k, v in parts.items() if k != "3"}

    store.change(edit)
    assert store.parts().keys() == {"1", "9"}
    store.change(lambda p: {k: v for k, v in p.items() if k != "9"})
    assert len(store.vacuum()) == 2 and history.load(spark, home).count() == 1
    history.save(assets, home, "1", "t", "again")  # a name is replaced
    assert history.load(spark, home).count() == 2


def test_decoded_snapshots(spark):
    assets = spark.createDataFrame([("k1", "RSA", 2048)], "asset_key string, family string, key_size int")
    rows = assets.select(history.snapshot(assets).alias("data")).union(spark.createDataFrame([("{bad",), (None,), ('{"family": "AES"}',)], "data string"))
    got = [(r.asset_key, r.family, r.key_size) for r in history.decoded(rows, "data", "asset_key string, family string, key_size int").collect()]
    assert sorted(got, key=str) == sorted([("k1", "RSA", 2048), ("None|None|None|None", None, None), ("None|None|None|None", None, None), ("AES|None|None|None", "AES", None)], key=str)


def test_merge_of_nothing(spark):
    empty = spark.createDataFrame([], FOUND + ", extra map<string,string>")
    assert inventory.assets(inventory.compatible(empty)).count() == 0 and merge.extras(empty, "family").count() == 0


def test_usage_in_the_plan(spark):
    rows = [
        (*finding("RSA", size=1024), "k.sign(x)", None), (*finding("RSA", size=1024, file="b.py"), "verify", None),
        (*finding("RSA", size=2048), "encrypt(x); verify(y)", None), (*finding("RSA", size=3072), "design, unsealed, resign", None),
        (*finding("RSA", size=4096), "encrypt(x)", {"key_usage": "digitalSignature"}), (*finding("RSA", size=512, kind="certificate"), "encrypt", None),
        (*finding("RSA", size=768), "x", {"usage": "key agreement"}), (*finding("RSA", size=896), None, None),
    ]
    a = {x.key_size: (x.usage, x.rule_id) for x in inventory.assets(spark.createDataFrame(rows, FOUND + ", evidence string, extra map<string,string>")).collect()}
    assert a == {1024: ("sign", "SIG_MLDSA"), 2048: (None, "AMBIGUOUS_USAGE"), 3072: (None, "AMBIGUOUS_USAGE"), 4096: ("sign", "SIG_MLDSA"), 512: ("sign", "SIG_MLDSA"), 768: ("kex", "KEM_HYBRID"), 896: (None, "AMBIGUOUS_USAGE")}
