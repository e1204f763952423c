import random
import re
import time

from cipherledger import tables as T
from cipherledger.operators import contexts, flat
from cipherledger.sources import corpus


def test_flat_rules_find_names_inside_names(spark):
    said = {
        "mlkem768": {"mlkem"}, "x25519mlkem768": {"ecdh", "mlkem"}, "hashlib.sha3_256": {"sha256"}, "sphincsplus": {"slhdsa"}, "createDiffieHellman(": {"ecdh"}, "diffie-hellman": {"dh"},
        "describes universal": set(), "DES3": {"des"}, "NewARC4": {"rc4"}, "sha-384 and MD5": {"sha256", "md5"}, "algorithms.AES": {"aes"}, "SigningKeys": {"ecdsa"}, "rsa_key": set(), "P-256": {"ecdsa"}, "_md5": set(), "é-md5é": {"md5"},
    }
    files = spark.createDataFrame([(k, k) for k in said], "path string, text string")
    got = {k: set() for k in said}
    for r in flat.findings(corpus.lines(flat.mentioning(files))).collect():
        got[r.path].add(r.rule)
    assert got == said


def test_where_a_match_lies(spark):
    text = 'x = "md5" # rsa\nraise E("rc4")\nlog.info("sha1"); run("des")\n/* md5\nrsa */ y = md5(1)\nthrow new Error(\'rsa\'); z = [\'md5\', `rsa\nrsa`]'
    files = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("d", "no names")], "path string, text string")
    got = [(r.rule, text[r.start : r.end], r.context, r.confidence) for r in contexts.findings(files).orderBy("start").collect()]
    assert got == [
        ("md5", "md5", "string", "high"), ("rsa", "rsa", "comment", "low"), ("rc4", "rc4", "string", "low"), ("sha1", "sha1", "string", "low"), ("des", "des", "string", "high"),
        ("md5", "md5", "comment", "low"), ("rsa", "rsa", "comment", "low"), ("md5", "md5", "code", "high"), ("rsa", "rsa", "string", "low"), ("md5", "md5", "string", "high"), ("rsa", "rsa", "string", "high"), ("rsa", "rsa", "string", "high"),
    ]


def test_long_intervals_and_blocks(spark):
    n = contexts.BLOCK
    text = "/*" + "x " * n + "md5 " + "y " * n + "*/ md5 " + "z" * (n - 1) + ' "' + "w " * n + 'rsa"'
    got = contexts.findings(spark.createDataFrame([("a", text)], "path string, text string")).orderBy("start").collect()
    assert [(r.rule, r.context) for r in got] == [("md5", "comment"), ("md5", "code"), ("rsa", "string")]


def test_points_meet_at_most_one_interval(spark):
    spans = spark.createDataFrame([("a", 0, 3, "string", True), ("a", 3, 4, "comment", None), ("a", 10, 10_000, "comment", None), ("b", 5, 6, "string", False)], "path string, start int, end int, kind string, handed boolean")
    points = spark.createDataFrame([("a", p) for p in (0, 2, 3, 4, 9, 10, 4096, 9999, 10_000)] + [("c", 5)], "path string, start int")
    got = {(r.path, r.start): r.kind for r in contexts.inside(points, spans).collect()}
    assert got == {("a", 0): "string", ("a", 2): "string", ("a", 3): "comment", ("a", 4): None, ("a", 9): None, ("a", 10): "comment", ("a", 4096): "comment", ("a", 9999): "comment", ("a", 10_000): None, ("c", 5): None}


def test_located_as_by_the_patterns_alone(spark):
    pick = random.Random(3)
    parts = ["md5", "MD5", "sha-3", "x25519", "mlkem", "Diffie hellman", "signingkey", "DES3", "aes.new", "P-256", "dhparameter_x", "ſha1", "slh-dſa", "Kyber", "\u212ayber", "rc4", "é", "_", "7", " ", "=", "raise ", "\\", "\n", "/", "*", "#", '"', "'", "`"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 30))) for _ in range(3000)]
    want = []
    for k, t in enumerate(texts):
        found = [(m.start(), m.end(), r) for r, (w, p) in T.FLAT_WORDS.items() for m in re.finditer(rf"(?<![A-Za-z0-9_])(?:{w})(?![A-Za-z0-9_])" + (f"|{p}" if p else ""), t, re.I | re.A)]
        spans = [m.span() for m in re.finditer(contexts.TOKEN, t)]
        assert list(contexts.intervals(t)) == spans
        want += [(str(k), s, e, r, next((("comment" if t[a] in "/#" else "string") for a, b in spans if a <= s < b), "code")) for s, e, r in found]
    got = [(r.path, r.start, r.end, r.rule, r.context) for r in contexts.findings(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")).collect()]
    assert sorted(got) == sorted(want) and len(want) > 1000


def test_texts_are_read_once(spark):
    plan = contexts.findings(spark.createDataFrame([("a", "md5 # rsa")], "path string, text string"))._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") == 0  # both sides of the join held the step over all texts


def test_texts_without_names_are_passed_over(spark):
    files = spark.range(0, 20, 1, 1).selectExpr("concat('f', id) AS path", "concat(repeat('plain words of prose ', 100000), if(id = 7, 'md5', '')) AS text")
    began = time.time()
    assert [(r.path, r.start) for r in contexts.findings(files).collect()] == [("f7", 2_100_000)]
    assert time.time() - began < 12  # thirteen patterns of Python's over all texts, twice


def test_what_is_not_closed_is_read_once(spark):
    n = 50_000
    text = "`" + "\\`" * n + " md5 '" + "\\'" * n + ' "rsa"'
    began = time.time()
    got = contexts.findings(spark.createDataFrame([("a", text)], "path string, text string")).orderBy("start").collect()
    assert [(r.rule, r.context) for r in got] == [("md5", "code"), ("rsa", "string")]
    assert time.time() - began < 20  # each escaped quote was read on to the end
