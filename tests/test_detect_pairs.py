"""Findings that depend on more than one call: references, generators, handles, objects, nesting."""

import time

from cipherledger.operators.detect import source
from cipherledger.operators.detect.masking import masked, spans


def found(lang, text):
    out, error = source.detect(lang, text)
    assert error is None, error
    return out


def short(lang, text):
    return [(f["line"], f["family"], f["key_size"], f["curve"], f["mode"]) for f in found(lang, text)]


def test_references_that_are_not_calls():
    assert [(f["family"], f["confidence"]) for f in found("python", "import hashlib\nD = hashlib.md5\ncall(hashlib.sha1)")] == [("MD5", "medium"), ("SHA-1", "medium")]
    # a call's own parts are told once
    assert len(found("python", "import hashlib, hmac\nhmac.new(k, m, hashlib.sha256)\nhmac.new(k, m, digestmod=hashlib.sha1)")) == 2
    assert len(found("python", "from cryptography.hazmat.primitives.ciphers import Cipher, algorithms, modes\nCipher(algorithms.AES(k), modes.GCM(iv))")) == 1
    assert [f["family"] for f in found("python", "from hashlib import md5\nx = {'a': md5}\ndef f(h=md5): return md5(b'')")] == ["MD5"] * 3
    assert found("python", "import hashlib\nraise ValueError(hashlib.md5)\nx = 'hashlib.md5'\nhashlib.new\nmd5") == []
    assert found("python", "import mine\nD = mine.md5\nmine.SECP256R1") == []
    tls = found("python", "import ssl\nc.minimum_version = ssl.TLSVersion.TLSv1\nx = ssl.PROTOCOL_SSLv3")
    assert [(f["family"], f["kind"]) for f in tls] == [("TLS1.0", "protocol"), ("SSLv3", "protocol")]
    assert [f["family"] for f in found("python", "from cryptography.hazmat.primitives.asymmetric.ed25519 import Ed25519PublicKey\nisinstance(k, Ed25519PublicKey)")] == ["Ed25519"]
    assert [f["family"] for f in found("python", "import thing\nrun(thing.ml_kem_768)")] == ["ML-KEM"]


def test_python_extras():
    (f,) = found("python", "import hashlib\nN = 1000\nhashlib.pbkdf2_hmac('sha256', p, s, N)")
    assert (f["family"], f["extra"]) == ("PBKDF2", {"iterations": "1000"})
    assert [(f["family"], f["extra"]) for f in found("python", "import jwt\njwt.decode(t, k, algorithms=['RS256', 'none'])")] == [("RSA", None), ("JWT", {"alg": "none"})]


def test_java_generators():
    two = 'KeyPairGenerator a = KeyPairGenerator.getInstance("RSA");\nKeyPairGenerator b = KeyPairGenerator.getInstance("DSA");\nb.initialize(3072);\na.initialize(1024);'
    assert short("java", two) == [(1, "RSA", 1024, None, None), (2, "DSA", 3072, None, None)]
    again = 'g = KeyPairGenerator.getInstance("RSA"); g.initialize(1024);\ng = KeyPairGenerator.getInstance("RSA"); g.initialize(4096);'
    assert short("java", again) == [(1, "RSA", 1024, None, None), (2, "RSA", 4096, None, None)]
    assert short("java", 'KeyPairGenerator.getInstance("EC").initialize(new ECGenParameterSpec("secp384r1"));') == [(1, "EC", None, "secp384r1", None)]
    assert short("java", 'g = KeyPairGenerator.getInstance("RSA");\n// g.initialize(512)\nh.initialize(512);') == [(1, "RSA", None, None, None)]
    assert short("java", 'g = KeyPairGenerator.getInstance("RSA"); g.initialize(new RSAKeyGenParameterSpec(2048, F4));') == [(1, "RSA", 2048, None, None)]
    assert short("java", 'x.use(new ECGenParameterSpec("secp256r1"));') == [(1, "EC", None, "secp256r1", None)]
    (name,) = {f["name"] for f in found("java", 'KeyPairGenerator.getInstance("RSA").initialize(1024);')}
    assert name == "RSA-1024"
    assert [f["family"] for f in found("java", 's.setEnabledProtocols(new String[] {"TLSv1", "SSLv3"});')] == ["TLS1.0", "SSLv3"]


def test_go_handles():
    assert short("go", "b, err := aes.NewCipher(key)\ng, _ := cipher.NewGCM(b)") == [(1, "AES", None, None, "GCM")]
    # the same variable in two functions, and two handles the other way round
    go = "func a() {\nb, _ := aes.NewCipher(k)\ncipher.NewCTR(b, iv)\n}\nfunc c() {\nb, _ := des.NewCipher(k)\nd, _ := aes.NewCipher(k)\ncipher.NewGCM(d)\ncipher.NewCBCEncrypter(b, iv)\n}"
    assert short("go", go) == [(2, "AES", None, None, "CTR"), (6, "DES", None, None, "CBC"), (7, "AES", None, None, "GCM")]
    assert short("go", "cipher.NewGCM(given)") == [(1, "Unknown", None, None, "GCM")]
    assert short("go", "b, _ := aes.NewCipher(k)\ncipher.NewGCM(b)\ncipher.NewCTR(b, iv)") == [(1, "AES", None, None, "GCM"), (1, "AES", None, None, "CTR")]
    assert [f["family"] for f in found("go", "c := tls.Config{\nMinVersion: tls.VersionTLS10,\nCipherSuites: []uint16{tls.TLS_RSA_WITH_RC4_128_SHA},\n}")] == ["TLS1.0", "RC4"]


def test_objects():
    js = 'crypto.subtle.generateKey({hash: {name: "SHA-1", modulusLength: 1}, name: "RSA-PSS", modulusLength: 2048}, a, b)'
    assert [(f["family"], f["key_size"], f["padding"]) for f in found("js", js)] == [("RSA", 2048, "PSS")]
    assert short("js", "generateKeyPairSync('ec', {\n  publicKeyEncoding: { type: 'spki' },\n  namedCurve: 'P-384',\n})") == [(1, "EC", None, "secp384r1", None)]
    assert [f["family"] for f in found("js", "https.request({ host, minVersion: 'TLSv1.1', ciphers: 'RC4-SHA:!AES128-SHA' })")][0] == "TLS1.1"
    assert [f["extra"] for f in found("js", "jwt.sign(p, k, { algorithm: 'none' })")] == [{"alg": "none"}]
    assert short("js", "crypto.pbkdf2(p, s, 10, 32, 'sha1', cb)")[0][1] == "PBKDF2"


def test_spans_are_linear_in_nested_and_unbalanced_text():
    took = []
    for n in (20_000, 80_000):
        text = "f(" * n + "x" + "}" * 5 + ")" * (n // 2)
        t = time.process_time()
        got = spans(*masked(text, "js"))
        took.append(time.process_time() - t)
        assert len(got) == n
    assert took[1] < 12 * took[0] + 0.5
    assert [s.args for s in spans("f(a, (b, c), [d, e])", "f(a, (b, c), [d, e])")][0] == ["a", "(b, c)", "[d, e]"]
