"""Names of algorithms as detectors meet them, as plain functions."""

from __future__ import annotations

import re
from functools import lru_cache, wraps

SHORT = 64  # characters of a name that is remembered


def remembered(told):
    """``told`` of a name, looked up once for each short name: files repeat the same few. At most 4,096 names a worker and function; results are
    shared, so callers never change them."""
    known = lru_cache(4096)(told)

    @wraps(told)
    def look(name):
        return known(name) if name is not None and len(name) <= SHORT else told(name)

    return look


CURVES = {"p256": "secp256r1", "prime256v1": "secp256r1", "secp256r1": "secp256r1", "p224": "secp224r1", "p384": "secp384r1", "secp384r1": "secp384r1", "p521": "secp521r1", "secp521r1": "secp521r1", "secp256k1": "secp256k1", "x25519": "x25519", "ed25519": "ed25519"}


@remembered
def curve(name: str | None) -> str | None:
    return CURVES.get(re.sub(r"[^a-z0-9]", "", name.lower())) if name else None


@remembered
def digest(name: str) -> dict | None:
    n = re.sub(r"[^a-z0-9]", "", name.lower())
    n = re.sub(r"^hmac", "", n)
    if m := re.fullmatch(r"md([245])", n):
        return {"family": f"MD{m[1]}", "key_size": None}
    if n in ("sha1", "sha", "sha160"):
        return {"family": "SHA-1", "key_size": None}
    if m := re.fullmatch(r"sha2?(224|256|384|512)", n):
        return {"family": "SHA-2", "name": f"SHA-{m[1]}", "key_size": int(m[1])}
    if m := re.fullmatch(r"sha3(224|256|384|512)", n):
        return {"family": "SHA-3", "name": f"SHA3-{m[1]}", "key_size": int(m[1])}
    if n.startswith("blake2"):
        return {"family": "BLAKE2", "key_size": None}
    if n.startswith(("ripemd", "rmd")):
        return {"family": "RIPEMD", "key_size": None}
    return None


@remembered
def cipher(name: str) -> dict | None:
    """OpenSSL (``aes-256-gcm``) and JCA (``AES/GCM/NoPadding``) spellings."""
    if "/" in name:
        head, mode, pad = (name.split("/") + [None, None])[:3]
        base = cipher(head)
        return base and base | {"mode": mode.upper() if base["family"] != "RSA" else None, "padding": pad}
    n = name.lower().replace("_", "-")
    mode = m[1].upper() if (m := re.search(r"-?(cbc|gcm|ctr|ecb|ccm|ofb|cfb|xts|ocb|siv)\d*$", n)) else None
    size = int(m[1]) if (m := re.search(r"(?<!\d)(128|192|256)(?!\d)", n)) else None
    heads = [("aes", "AES"), ("des-ede", "3DES"), ("desede", "3DES"), ("des3", "3DES"), ("3des", "3DES"), ("triple", "3DES"), ("des", "DES"), ("rc4", "RC4"), ("arc4", "RC4"), ("arcfour", "RC4"), ("rc2", "RC2"), ("bf", "Blowfish"), ("blowfish", "Blowfish"), ("chacha20", "ChaCha20"), ("camellia", "Camellia"), ("aria", "ARIA"), ("rsa", "RSA"), ("cast", "CAST5"), ("idea", "IDEA")]
    for h, f in heads:
        if n.startswith(h):
            return {"family": f, "key_size": 256 if f == "ChaCha20" else size if f in ("AES", "Camellia", "ARIA") else None, "mode": mode}
    return None


PQC = [(r"ml[-_ ]?kem|kyber", "ML-KEM"), (r"ml[-_ ]?dsa|dilithium", "ML-DSA"), (r"slh[-_ ]?dsa|sphincs", "SLH-DSA"), (r"falcon|fn[-_]?dsa", "Falcon"), (r"frodokem", "FrodoKEM"), (r"(?<![a-z])hqc", "HQC"), (r"mceliece", "Classic-McEliece"), (r"(?<![a-z])bike", "BIKE")]


@remembered
def pqc(name: str) -> dict | None:
    for p, f in PQC:
        if re.search(p, name, re.I):
            m = re.search(r"(?<!\d)(512|768|1024|44|65|87)(?!\d)", name)
            return {"family": f, "key_size": int(m[1]) if m else None}
    return None


@remembered
def jwt(alg: str) -> dict | None:
    a = alg.upper()
    if re.fullmatch(r"HS(256|384|512)", a):
        return {"family": "HMAC", "key_size": int(a[2:])}
    if re.fullmatch(r"[RP]S(256|384|512)", a):
        return {"family": "RSA", "key_size": None, "padding": "PSS" if a[0] == "P" else "PKCS1v15"}
    if re.fullmatch(r"ES(256K?|384|512)", a):
        return {"family": "ECDSA", "key_size": None, "curve": {"ES256": "secp256r1", "ES384": "secp384r1", "ES512": "secp521r1", "ES256K": "secp256k1"}[a]}
    return {"family": "Ed25519", "key_size": None, "curve": "ed25519"} if a == "EDDSA" else None


def canonical(f: dict) -> str:
    """The display name: family, then size, curve and mode where they are known (RSA-1024, AES-256-GCM)."""
    parts = [f["family"], f.get("key_size"), f.get("curve") if f["family"] not in ("Ed25519", "Ed448", "X25519", "X448") else None, f.get("mode")]
    return "-".join(str(x) for x in parts if x)


@remembered
def tls(name: str) -> str | None:
    n = re.sub(r"[^a-z0-9]", "", name.lower())
    for p, v in (("tlsv?13", "TLS1.3"), ("tlsv?12", "TLS1.2"), ("tlsv?11", "TLS1.1"), ("sslv?3|ssl30", "SSLv3"), ("sslv?2(?!3)", "SSLv2"), ("tlsv?1(?:0)?$", "TLS1.0")):
        if re.search(p, n):
            return v
    return None
