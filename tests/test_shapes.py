"""Findings that are remembered by a text's shape are those of reading each text."""

import random
import re

import pytest
from cipherledger.operators.detect import run, shapes, source
from cipherledger.sources import code

FILES = {
    "js": "const c = require('crypto');\nCryptoJS.blake212345(x); CryptoJS.rc412345.go(y);\nc.createHash('sha512');c.createHash('blake2123456'); kyber123456(x); c.createSign('RSA-SHA123456');\nx123456 = c.pbkdf2Sync(p123456, s, 123456, 32, 'sha512');\nnew NodeRSA({ b: 123456 }); f123456(1, 'a123456'); tls.connect({ minVersion: 'TLSv1.2', a123456: 4 }); // 123456\n",
    "java": 'class A123456 { KeyPairGenerator a = KeyPairGenerator.getInstance("RSA"); KeyPairGenerator b123456 = KeyPairGenerator.getInstance("DSA"); b123456.initialize(2048); a.initialize(123456); log("x 123456"); Signature.getInstance("X123456"); f123456(a); new PBEKeySpec(p, s, 123456); SSLContext.getInstance("TLSv112345"); }\n',
    "go": 'package main\nimport ("golang.org/x/crypto/blake2123456"; "crypto/md5")\nfunc f123456() { h123456 := aes.NewCipher(key123456); g := cipher.NewGCM(h123456); sha512.New123456(); rsa.GenerateKey(r, 123456); T123456{a: 1}; pbkdf2.Key(a, b, 123456, d) }\n',
    "python": "import hashlib as h, hmac, ssl\nfrom hashlib import blake2123456 as made\nfrom cryptography.hazmat.primitives.ciphers import Cipher, algorithms\nrun123456(made, h.md5(b'x'))\nhmac.new(k, m, blake2123456)\nssl.SSLContext(tlsv112345)\nx123456 = 2048\nh.new('sha123456')\nCipher(algorithms.AES(k), X123456(iv))\nf = 1.e123456 + 0xA123456\n",
    "c": "EVP_blake212345(); EVP_rc4567890(); DES_x312345(); f123456(); RSA_generate_key_ex(r, 123456, e, 0);\n",
}
NUMBERS = [212345, 412345, 312345, 333333, 123456, 999999, 2048, 4096, 25519]


def as_read(lang, text, known):
    told, error = known.detect(lang, text)
    return [f | {"evidence": e} for f, e in zip(told.found, told.evidence(text))], error


def lines_of(lang):
    """Every line of a file alone, and the file: a line may hold the only number that forbids remembering."""
    return [FILES[lang], *(f"{head}{x}\n" for head in ("", "import hashlib as h\n" if lang == "python" else "") for x in re.split(r"\n|(?<=;) ", FILES[lang]) if x)]


@pytest.mark.parametrize("lang", FILES)
def test_numbers_anywhere_change_what_reading_would_change(lang):
    rnd, known = random.Random(lang), shapes.Shapes()
    for base in lines_of(lang):
        for _ in range(60):
            at = rnd.randrange(len(base) + 1)
            text = base if rnd.random() < 0.5 else base[:at] + str(rnd.choice(NUMBERS)) + base[at:]
            for _ in range(3):
                one = re.sub("[0-9]{4,}", lambda m: str(rnd.choice(NUMBERS)), text)
                assert as_read(lang, one, known) == source.detect(lang, one), one


def order_files(spark, tmp_path, lang, n):
    spark.range(n).selectExpr("1000000 + id AS o_orderkey", "200000 + id * 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    return [r.text for r in code.files(spark, str(tmp_path), lang).collect()]


def read_once(spark, tmp_path, monkeypatch, lang, most):
    texts, seen, own = order_files(spark, tmp_path, lang, 600), [], source.traced
    monkeypatch.setattr(source, "traced", lambda *a: (seen.append(1), own(*a))[1])
    known = shapes.Shapes()
    got = [as_read(lang, t, known) for t in texts]
    assert len(seen) <= most  # each of the 600 was read before
    assert got == [source.detect(lang, t) for t in texts] and len({e["evidence"] for f, _ in got for e in f}) > 1


def test_js_objects_are_read_once_a_shape(spark, tmp_path, monkeypatch):
    read_once(spark, tmp_path, monkeypatch, "js", 60)


def test_java_generators_are_read_once_a_shape(spark, tmp_path, monkeypatch):
    read_once(spark, tmp_path, monkeypatch, "java", 60)


def test_python_references_are_read_once_a_shape(spark, tmp_path, monkeypatch):
    read_once(spark, tmp_path, monkeypatch, "python", 60)


def test_go_handles_are_read_once_a_shape(spark, tmp_path, monkeypatch):
    read_once(spark, tmp_path, monkeypatch, "go", 60)


def test_memory_is_bounded():
    known = shapes.Shapes()
    for k in range(3 * shapes.VALUES):
        known.detect("js", f"new NodeRSA({{ b: {k + 1000} }});")  # one shape, its number is read
        assert known.values <= shapes.VALUES and len(known.known) <= shapes.SHAPES
    for k in range(3 * shapes.SHAPES):
        known.detect("js", "a();" * (k % 1700))
        assert len(known.known) <= shapes.SHAPES
    long = "x(1);" * shapes.LONGEST
    known.detect("go", long)
    assert ("go", long) not in known.known


def test_only_the_fields_asked_for_are_made(spark):
    files = spark.createDataFrame([("a", "js", "c.createHash('md5');\nnew NodeRSA({ b: 2048 });"), ("b", "python", "def ("), ("c", "js", None)], "path string, lang string, text string")
    every = run.sources(files).select("family", "file", "error", "extra").collect()
    assert run.sources(files, ["family", "file", "error", "extra"]).collect() == every and len(every) == 3
    assert [r.evidence for r in run.sources(files, ["evidence", "line"]).where("line is not null").collect()] == ["c.createHash('md5');", "new NodeRSA({ b: 2048 });"]
