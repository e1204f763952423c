from pyspark.sql import Row

from cipherledger.operators import classify, gate, recommend

TODAY = "2026-06-01"
WAIVER = "ord int, family string, severity_is string, file_regex string, reason string, expires string"


def _assets(spark):
    rows = [("k1", "MD5", "MD5", "critical", 4, True, 90.0), ("k2", "RC4", "RC4", "high", 3, False, 70.0)]
    assets = spark.createDataFrame(rows, "asset_key string, family string, name string, severity string, severity_rank int, act_now boolean, score double")
    places = spark.createDataFrame([("k1", "health/a.py"), ("k1", "src/b.py"), ("k2", "health/c.py")], "asset_key string, file string")
    return assets, places


def test_ignored_only_with_all_places(spark):
    assets, places = _assets(spark)
    got = {r.asset_key: r for r in gate.flagged(assets, "high", ignore=["health"], places=places).collect()}
    assert not got["k1"].ignored and got["k1"].blocking and got["k2"].ignored and not got["k2"].blocking


def test_waived_only_with_all_places(spark):
    assets, places = _assets(spark)
    flags = gate.flagged(assets, "high")
    w = spark.createDataFrame([(1, None, None, "^health/", "ok", "2027-01-01")], WAIVER)
    out = gate.waived(flags, w, TODAY, places)
    assert {r.asset_key: r.waiver_ord for r in out.collect()} == {"k1": None, "k2": 1}
    v = gate.verdict(out).first()
    assert (v.n_blocking, v.n_waived, v.exit_code) == (1, 1, 1)
    both = spark.createDataFrame([(1, None, None, "^(health|src)/", "ok", "2027-01-01")], WAIVER)
    assert gate.verdict(gate.waived(flags, both, TODAY, places)).first().exit_code == 0
    by = spark.createDataFrame([Row(ord=1, family=None, severity_is=None, file_regex=None, reason="r", expires="2027-01-01", key="k1", name=None), Row(ord=2, family="rc4", severity_is=None, file_regex=None, reason="r", expires="2020-01-01", key=None, name="RC4")], WAIVER + ", key string, name string")
    got = {r.asset_key: (r.waiver_ord, r.waiver_expired) for r in gate.waived(flags, by, TODAY, places).collect()}
    assert got == {"k1": (1, False), "k2": (2, True)}
    nothing = spark.createDataFrame([(1, None, None, None, "ok", "2027-01-01")], WAIVER)
    assert gate.waived(flags, nothing, TODAY, places).where("waiver_ord is not null").count() == 0


def test_no_unsafe_rewrites():
    for family, line in {"AES": 'Cipher.getInstance("AES/ECB/PKCS5Padding")', "MD5": "EVP_DigestInit(c, EVP_md5());", "SHA-1": "EVP_DigestInit(c, EVP_sha1());"}.items():
        assert recommend.one_patch(family, "x", [1], line) is None
    assert recommend.one_patch("AES", "x.js", [1], "createCipheriv('aes-128-gcm', key, iv)") is None
    assert "+h = hashlib.sha256(b)" in recommend.one_patch("MD5", "x.py", [1], "h = hashlib.md5(b)")


def test_inner_hash(spark):
    rows = [("HMAC", "HMAC-MD5", None, None), ("HMAC", "HmacSHA1", 160, None), ("HMAC", "HMAC-SHA-2", 256, None), ("HMAC", "HMAC", None, None)]
    d = spark.createDataFrame(rows, "family string, name string, key_size int, mode string")
    assert [r.threat for r in classify.classified(d).collect()] == ["legacy_broken", "grover_weakened", "quantum_safe", "quantum_safe"]


def _waivers(spark, *rows):
    names = "ord family severity_is file_regex reason expires key name".split()
    return spark.createDataFrame([Row(**{n: {"ord": k, "reason": "r", "expires": "2027-01-01", **r}.get(n) for n in names}) for k, r in enumerate(rows, 1)], WAIVER + ", key string, name string")


def test_a_severity_is_no_waiver_field(spark):
    assets, places = _assets(spark)
    flags = gate.flagged(assets, "high")
    out = gate.waived(flags, _waivers(spark, {"severity_is": "critical"}, {"severity_is": "low", "family": "RC4"}), TODAY, places)
    assert {r.asset_key: r.waiver_ord for r in out.collect()} == {"k1": None, "k2": 2}
    assert gate.verdict(out).first().exit_code == 1


def test_a_key_is_family_size_curve_and_mode(spark):
    rows = [("AES|128|None|ECB|AES-128-ECB|algorithm", "AES", "AES-128-ECB", "high", 3, False, 9.0), ("AES|128|None|CBC|AES-128-CBC|algorithm", "AES", "AES-128-CBC", "high", 3, False, 8.0)]
    assets = spark.createDataFrame(rows, "asset_key string, family string, name string, severity string, severity_rank int, act_now boolean, score double")
    places = spark.createDataFrame([(r[0], "a.py") for r in rows], "asset_key string, file string")
    out = gate.waived(gate.flagged(assets, "high"), _waivers(spark, {"key": "AES|128|None|ECB"}), TODAY, places)
    assert [r.waiver_ord for r in out.orderBy("score").collect()] == [None, 1]
    # waived assets aren't offenders
    assert [r.name for r in gate.offenders(out).collect()] == ["AES-128-CBC"]


def test_off_never_fails_and_budgets_count_what_is_reported(spark):
    assets, places = _assets(spark)
    off = gate.waived(gate.flagged(assets, None, mosca_blocks=True), _waivers(spark), TODAY, places)
    v = gate.verdict(off, {"critical": 0, "high": 0}, on=False, errors=3).first()
    assert (v.n_blocking, v.n_over_budget, v.exit_code) == (0, 0, 0)
    below = gate.waived(gate.flagged(assets, "critical", floor="critical"), _waivers(spark, {"family": "md5"}), TODAY, places)
    assert gate.verdict(below, {"high": 0}).first().n_over_budget == 0
    assert gate.verdict(below, {"critical": 0}).first().exit_code == 1
    assert [gate.verdict(below, {}, errors=1, errors_block=b).first().exit_code for b in (False, True)] == [0, 2]


def test_summary_names_offenders_and_places(spark):
    assets, places = _assets(spark)
    out = gate.waived(gate.flagged(assets, "high"), _waivers(spark, {"family": "RC4", "expires": "2020-01-01"}), TODAY, places)
    v = gate.verdict(out).first().asDict()
    text = gate.summary(v, [r.asDict() | {"file": "a/" * 40 + "f.py", "line": 7} for r in gate.offenders(out, 1).collect()], "high", ["x: bad"])
    assert "FAIL" in text and "MD5" in text and "f.py:7" in text and "1 more" in text and "1 with an expired" in text and "x: bad" in text
    assert gate.cut_right("abcdef", 4) == "abc~" and gate.cut_left("abcdef", 4) == "~def" and gate.cut_left("abc", 4) == "abc"
