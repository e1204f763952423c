"""Detectors on small files."""

import base64

from cipherledger.operators import recommend
from cipherledger.operators.detect import material, source

PY = '''import hashlib as h
from cryptography.hazmat.primitives.asymmetric import rsa, ec, ed25519, x25519
from cryptography.hazmat.primitives.ciphers import Cipher, algorithms, modes
BITS = 1024
rsa.generate_private_key(public_exponent=65537, key_size=BITS)
ec.generate_private_key(ec.SECP256R1())
ed25519.Ed25519PrivateKey.generate()
x25519.X25519PrivateKey.generate()
h.md5(b"x")
h.new("sha1")
h.sha256(b"y")
Cipher(algorithms.AES(k), modes.GCM(iv))
Cipher(algorithms.AES(k), modes.ECB())
Cipher(algorithms.TripleDES(k), modes.CBC(iv))
# hashlib.sha512(b"no")
raise ValueError("RC4 is not allowed")
'''


def _families(found):
    return {(f["family"], f["key_size"], f["mode"]) for f in found}


def test_python():
    found, error = source.detect("python", PY)
    assert error is None
    assert {("RSA", 1024, None), ("Ed25519", None, None), ("X25519", None, None), ("MD5", None, None), ("SHA-1", None, None), ("SHA-2", 256, None), ("AES", None, "GCM"), ("AES", None, "ECB"), ("3DES", None, "CBC")} <= _families(found)
    assert next(f for f in found if f["family"] == "ECDSA")["curve"] == "secp256r1"
    assert all(f["line"] < 15 for f in found)
    assert source.detect("python", "def (")[1]


def test_javascript():
    found, _ = source.detect("js", "const c=require('crypto');\nc.generateKeyPairSync('rsa',{modulusLength:2048});\nc.generateKeyPairSync('ed25519');\nc.createHash('sha1');\nc.createCipheriv('aes-256-gcm',k,i);\nc.createCipheriv('rc4',k,'');\n// c.createHash('md5')\nthrow new Error('md5');\n")
    assert _families(found) == {("RSA", 2048, None), ("Ed25519", None, None), ("SHA-1", None, None), ("AES", 256, "GCM"), ("RC4", None, None)}


def test_java_go_c():
    java, _ = source.detect("java", 'Cipher.getInstance("AES/ECB/PKCS5Padding"); Cipher.getInstance("DES"); MessageDigest.getInstance("MD5"); // Cipher.getInstance("RC4")')
    assert {f[0] for f in _families(java)} == {"AES", "DES", "MD5"}
    go, _ = source.detect("go", 'import ("crypto/rsa"; "crypto/md5")\nfunc f() { rsa.GenerateKey(rand.Reader, 2048); md5.New() }')
    assert _families(go) == {("RSA", 2048, None), ("MD5", None, None)}
    c, _ = source.detect("c", '#include <openssl/evp.h>\nEVP_aes_256_gcm(); EVP_des_ede3_cbc(); EVP_md5(); RSA_generate_key_ex(r, 1024, e, 0); EC_KEY_new_by_curve_name(NID_X9_62_prime256v1); puts("RC4"); /* EVP_sha1() */')
    assert {("AES", 256, "GCM"), ("3DES", None, "CBC"), ("MD5", None, None), ("RSA", 1024, None)} <= _families(c)
    assert not {"RC4", "SHA-1"} & {f["family"] for f in c}
    assert next(f for f in c if f["family"] == "EC")["curve"] == "secp256r1"
    assert any(f["kind"] == "library" for f in c)


def test_keys():
    der = bytes.fromhex("302a300506032b6570032100") + bytes(32)
    pem = b"-----BEGIN PUBLIC KEY-----\n" + base64.b64encode(der) + b"\n-----END PUBLIC KEY-----\n"
    (k,) = material.keys(b"x\n" + pem)
    assert (k["family"], k["key_size"], k["line"], k["kind"]) == ("Ed25519", 256, 2, "key")
    n = b"\x00" + b"\xff" * 128
    blob = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-rsa", b"\x01\x00\x01", n))
    (s,) = material.keys(b"ssh-rsa " + base64.b64encode(blob) + b" me\n")
    assert (s["family"], s["key_size"]) == ("RSA", 1024)
    assert material.keys(b"-----BEGIN RSA PRIVATE KEY-----\nzz\n-----END RSA PRIVATE KEY-----")[0]["family"] == "RSA"


def test_manifests():
    assert material.manifest("a/requirements.txt", "Crypto_Graphy[x]==41.0\n# no\nrequests") == [("pypi", "crypto-graphy", "41.0", 1), ("pypi", "requests", None, 3)]
    assert material.manifest("package.json", '{"dependencies": {"node-rsa": "^1.0.8"}}') == [("npm", "node-rsa", "1.0.8", 1)]
    assert material.manifest("go.mod", "module m\nrequire (\n\tgolang.org/x/crypto v0.1.0\n)") == [("go", "golang.org/x/crypto", "0.1.0", 3)]
    assert material.manifest("pom.xml", "<project><properties><bc.v>1.70</bc.v></properties><dependency><artifactId>bcprov-jdk18on</artifactId><version>${bc.v}</version></dependency></project>")[0][1:3] == ("bcprov-jdk18on", "1.70")
    assert material.manifest("Cargo.toml", '[dependencies]\nring = "0.16"\n') == [("cargo", "ring", "0.16", 2)]


def test_patches():
    p = recommend.one_patch("MD5", "a.py", [2], "import hashlib\nx = hashlib.md5(b)\n")
    assert "+x = hashlib.sha256(b)" in p
    assert recommend.one_patch("MD5", "a.py", [2], "import hashlib as h\nx = h.md5(b)\n") is None
    assert recommend.one_patch("MD5", "a.py", [2], "# checksum of the release\nx = hashlib.md5(b)\n") is None
