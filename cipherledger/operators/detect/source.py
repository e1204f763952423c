"""Source detectors: Python on its syntax tree, the C family on masked text."""

from __future__ import annotations

import ast
import bisect
import re

from . import names as N
from .masking import Span, integer, literal, masked, spans


_SPACE = re.compile(r"\s+")


def evidence(line: str) -> str:
    """What a finding shows of its line."""
    return _SPACE.sub(" ", line).strip()[:180]


def _finding(line, shown, detector, f, confidence="high", kind="algorithm"):
    extra = {k: str(v) for k, v in (f.get("extra") or {}).items() if v is not None}
    plain = {k: f.get(k) for k in ("family", "key_size", "curve", "mode", "padding")}
    return plain | {"line": line, "evidence": evidence(shown), "detector": detector, "confidence": f.get("confidence", confidence), "kind": kind, "name": f.get("name") or N.canonical(f), "extra": extra or None}


# --- Python -----------------------------------------------------------------------------------------------------------

_PY_CRYPTO = ("hashlib", "hmac", "ssl", "cryptography", "Crypto", "Cryptodome", "nacl", "jwt", "jose", "oqs", "rsa", "ecdsa", "paramiko", "bcrypt", "argon2")
_PY_CIPHERS = {"AES": "AES", "DES3": "3DES", "DES": "DES", "ARC4": "RC4", "ARC2": "RC2", "Blowfish": "Blowfish", "ChaCha20": "ChaCha20", "ChaCha20_Poly1305": "ChaCha20", "TripleDES": "3DES", "Camellia": "Camellia", "SEED": "SEED", "IDEA": "IDEA", "CAST5": "CAST5", "CAST": "CAST5", "SM4": "SM4"}
_PY_AEAD = {"AESGCM": ("AES", "GCM"), "AESCCM": ("AES", "CCM"), "AESSIV": ("AES", "SIV"), "AESOCB3": ("AES", "OCB"), "ChaCha20Poly1305": ("ChaCha20", None), "Fernet": ("AES", "CBC")}
_PY_KEYS = {"Ed25519PrivateKey": "Ed25519", "Ed448PrivateKey": "Ed448", "X25519PrivateKey": "X25519", "X448PrivateKey": "X448"}
_PY_KDF = {"PBKDF2HMAC": "PBKDF2", "pbkdf2_hmac": "PBKDF2", "PBKDF2": "PBKDF2", "HKDF": "HKDF", "Scrypt": "scrypt", "scrypt": "scrypt", "Argon2id": "Argon2", "PasswordHasher": "Argon2"}


#: Syntax nodes that hold no others.
_LEAVES = {ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias, *ast.operator.__subclasses__(), *ast.unaryop.__subclasses__(), *ast.boolop.__subclasses__(), *ast.cmpop.__subclasses__()}
_RSA_MADE = (".rsa.generate_private_key", ".RSA.generate")
_DSA_DH_MADE = (".dsa.generate_private_key", ".dsa.generate_parameters", ".dh.generate_private_key", ".dh.generate_parameters", ".DSA.generate")
_EC_MADE = (".ec.generate_private_key", ".ECC.generate")


_NUMBERED = re.compile(r"[A-Za-z_][0-9]{6}")


class _Python:
    def visit(self, node):
        own = self.kinds.get(node.__class__)
        if own:
            own(self, node)
        else:
            self.generic_visit(node)

    def generic_visit(self, node):
        for field in node._fields:
            value = getattr(node, field, None)
            for x in value if value.__class__ is list else (value,):
                if isinstance(x, ast.AST) and x.__class__ not in _LEAVES:
                    self.visit(x)

    def __init__(self, text: str):
        self.lines, self.alias, self.const, self.out, self.used = text.split("\n"), {}, {}, [], set()
        self.refs, self.taken, self.imported = [], set(), set()
        self.looked = False  # whether a rule looked into a name that ends in a long number

    def visit_Import(self, node):
        for a in node.names:
            self.alias[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            self.imported.add(a.asname or a.name.split(".")[0])

    def visit_ImportFrom(self, node):
        for a in node.names:
            self.alias[a.asname or a.name] = f"{node.module or ''}.{a.name}"
            self.imported.add(a.asname or a.name)

    def visit_Assign(self, node):
        if len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Constant):
            self.const.setdefault(node.targets[0].id, node.value.value)
        self.generic_visit(node)

    def visit_Raise(self, node):  # names in messages aren't uses
        return

    def dotted(self, node) -> str:
        name = self.joined(node)
        self.looked = self.looked or _NUMBERED.search(name) is not None
        return name

    def joined(self, node) -> str:
        """``dotted``, for what only asks for the module of a name or for words in it."""
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name):
            return ""
        return ".".join([self.alias.get(node.id, node.id), *reversed(parts)])

    def value(self, node):
        if isinstance(node, ast.Constant):
            return node.value
        return self.const.get(node.id) if isinstance(node, ast.Name) else None

    def arg(self, node, i, *names):
        for k in node.keywords:
            if k.arg in names:
                return k.value
        return node.args[i] if i is not None and i < len(node.args) else None

    def take(self, node):
        """What a call's finding already tells is no finding of its own."""
        while node is not None:
            self.taken.add(id(node))
            node = node.func if isinstance(node, ast.Call) else node.value if isinstance(node, ast.Attribute) else None

    def add(self, node, f, **how):
        self.out.append(_finding(node.lineno, self.lines[node.lineno - 1], "python", f, **how))

    def hash_of(self, node):
        if node is None:
            return None
        self.take(node)
        d = self.dotted(node.func if isinstance(node, ast.Call) else node)
        return N.digest(d.rsplit(".", 1)[-1]) if d else N.digest(node.value) if isinstance(node, ast.Constant) and isinstance(node.value, str) else None

    def visit_Call(self, node):
        name = self.joined(node.func)
        root, last = name.split(".")[0], name.rsplit(".", 1)[-1]
        self.take(node.func)
        if root in _PY_CRYPTO:
            self.crypto(node, name, last)
        elif p := (N.pqc(name) if name else None):
            self.add(node, p, confidence="medium")
        self.generic_visit(node)

    def crypto(self, node, name, last):
        size = self.value(self.arg(node, None, "key_size", "bits")) or next((v for a in node.args if isinstance(v := self.value(a), int) and v >= 256 and v != 65537), None)
        if name.startswith("hashlib."):
            f = N.digest(str(self.value(self.arg(node, 0, "name")) or "")) if last == "new" else N.digest(last)
            if last in _PY_KDF:
                f = self.kdf(node, last)
            if f:
                self.add(node, f)
        elif name.startswith("hmac."):
            h = self.hash_of(self.arg(node, 2, "digestmod", "digest"))
            self.add(node, {"family": "HMAC", "name": f"HMAC-{h['family']}" if h else "HMAC", "key_size": h and h.get("key_size")})
        elif name.endswith(_RSA_MADE) or name == "rsa.newkeys":
            self.add(node, {"family": "RSA", "key_size": size})
        elif name.endswith(_DSA_DH_MADE):
            self.add(node, {"family": "DH" if ".dh." in name else "DSA", "key_size": size})
        elif name.endswith(_EC_MADE):
            c = self.arg(node, 0, "curve")
            self.take(c)
            d = self.dotted(c.func if isinstance(c, ast.Call) else c) if c is not None else ""
            self.add(node, {"family": "ECDSA", "curve": N.curve(d.rsplit(".", 1)[-1] or str(self.value(c) or ""))})
        elif last in ("ECDSA", "ECDH") and ".ec." in name:
            self.add(node, {"family": last})
        elif name.rsplit(".", 2)[-2:-1] and name.rsplit(".", 2)[-2] in _PY_KEYS:
            self.add(node, {"family": _PY_KEYS[name.rsplit(".", 2)[-2]]})
        elif last == "SigningKey":
            self.add(node, {"family": "Ed25519" if name.startswith("nacl") else "ECDSA"})
        elif last == "Cipher" and ".ciphers." in name:
            a, m = self.arg(node, 0, "algorithm"), self.arg(node, 1, "mode")
            self.take(a)
            self.take(m)
            if isinstance(a, ast.Call):
                self.used.add(id(a))
                alg, mode = self.dotted(a.func).rsplit(".", 1)[-1], self.dotted(m.func).rsplit(".", 1)[-1] if isinstance(m, ast.Call) else None
                if alg in _PY_CIPHERS:
                    self.add(node, {"family": _PY_CIPHERS[alg], "mode": mode})
        elif last in _PY_AEAD:
            f, m = _PY_AEAD[last]
            self.add(node, {"family": f, "mode": m})
        elif ".algorithms." in name and last in _PY_CIPHERS and id(node) not in self.used:
            self.add(node, {"family": _PY_CIPHERS[last]})
        elif last == "new" and (c := name.split(".")[-2]) in _PY_CIPHERS and name.startswith(("Crypto.", "Cryptodome.")):
            m = self.arg(node, 1, "mode")
            self.take(m)
            mode = re.sub("^MODE_", "", self.dotted(m).rsplit(".", 1)[-1]) if m is not None else None
            self.add(node, {"family": _PY_CIPHERS[c], "mode": mode or None})
        elif ".hashes." in name or ".Hash." in name:
            h = N.digest(last if last != "new" else name.split(".")[-2])
            if h:
                self.add(node, h)
        elif last in _PY_KDF:
            self.add(node, self.kdf(node, last))
        elif last in ("PKCS1v15", "OAEP", "PSS") and "padding" in name:
            self.add(node, {"family": "RSA", "name": f"RSA-{last}", "padding": last})
        elif name.startswith(("jwt.", "jose.")) and last in ("encode", "decode"):
            a = self.arg(node, 2, "algorithm", "algorithms")
            for v in a.elts if isinstance(a, (ast.List, ast.Tuple)) else [a]:
                said = str(self.value(v) or "") if v is not None else ""
                if j := N.jwt(said) or (JWT_NONE if said.lower() == "none" else None):
                    self.add(node, j)
        elif name.startswith("ssl.") and last in ("SSLContext", "wrap_socket", "create_default_context"):
            v = self.arg(node, 0 if last == "SSLContext" else None, "ssl_version")
            t = N.tls(self.dotted(v)) if v is not None else None
            self.take(v)
            self.add(node, {"family": t or "TLS"}, kind="protocol")
        elif last == "set_ciphers" and isinstance(s := self.value(self.arg(node, 0)), str):
            for part in s.split(":"):
                if c := N.cipher(part.lstrip("!+-").split("-")[-1] if part.startswith("RC4") else part):
                    self.add(node, c, confidence="medium")
        elif name.startswith("oqs.") and isinstance(s := self.value(self.arg(node, 0)), str) and (p := N.pqc(s)):
            self.add(node, p)

    def kdf(self, node, last):
        n = self.value(self.arg(node, 3 if last == "pbkdf2_hmac" else 1 if last == "PBKDF2" else None, "iterations", "count"))
        if _PY_KDF[last] == "PBKDF2":
            self.take(self.arg(node, 0, "algorithm", "hmac_hash_module", "hash_name"))
        return {"family": _PY_KDF[last], "extra": {"iterations": n if isinstance(n, int) else None}}

    def visit_Attribute(self, node):
        self.refs.append(node)  # the whole chain; its parts are no references of their own
        inner = node
        while isinstance(inner, ast.Attribute):
            inner = inner.value
        if not isinstance(inner, ast.Name):
            self.visit(inner)

    def visit_Name(self, node):
        if isinstance(node.ctx, ast.Load) and node.id in self.imported:
            self.refs.append(node)

    def references(self):
        """Names of algorithms that are passed, assigned or returned rather than called; those a call took are left out."""
        for node in self.refs:
            if id(node) not in self.taken and (f := self.reference(self.joined(node))):
                kind = "protocol" if f["family"].startswith(("TLS", "SSL")) else "algorithm"
                self.add(node, f, confidence=f.get("confidence", "medium"), kind=kind)

    def reference(self, name: str) -> dict | None:
        parts = name.split(".")
        last, owner, known = parts[-1], parts[-2] if len(parts) > 1 else "", parts[0] in _PY_CRYPTO
        if ("ssl" in parts or owner == "TLSVersion") and (t := N.tls(last)):
            return {"family": t, "confidence": "high"}
        if p := next((p for x in parts if _PY_PQC.fullmatch(x) and (p := N.pqc(x))), None):
            return p | {"confidence": "high" if known else "medium"}
        if not known:
            return None
        if owner in _PY_KEYS or last in _PY_KEYS or last.replace("Public", "Private") in _PY_KEYS:
            return {"family": _PY_KEYS.get(owner) or _PY_KEYS[last.replace("Public", "Private")]}
        if owner in ("hashlib", "hashes", "Hash"):
            return N.digest(last)
        if owner == "ec" and (c := N.curve(last)):
            return {"family": "ECDSA", "curve": c}
        if owner == "algorithms" and last in _PY_CIPHERS:
            return {"family": _PY_CIPHERS[last]}
        return None

    kinds = {ast.Import: visit_Import, ast.ImportFrom: visit_ImportFrom, ast.Assign: visit_Assign, ast.Raise: visit_Raise, ast.Call: visit_Call, ast.Attribute: visit_Attribute, ast.Name: visit_Name}


JWT_NONE = {"family": "JWT", "name": "JWT-none", "extra": {"alg": "none"}}
_PY_PQC = re.compile(r"(ml_?kem|kyber|ml_?dsa|dilithium|slh_?dsa|sphincs|falcon|fn_?dsa|frodokem|hqc|mceliece|bike)[_\d]*\w*", re.I)


def _blind(v: _Python, tree: ast.AST, text: str) -> bool:
    """Whether names that end in six digits or more stand only where rules can't tell one from another: names of variables and functions
    that are neither imported nor constants. Escapes in strings may be wrong by their digits."""
    if v.looked or "\\" in text or any(map(_NUMBERED.search, [*v.alias, *v.alias.values(), *map(str, v.const)])):
        return False
    for x in ast.walk(tree):
        said = x.value if x.__class__ is ast.Constant else x.attr if x.__class__ is ast.Attribute else None
        said = said.decode("latin-1") if isinstance(said, bytes) else said
        if isinstance(said, str) and _NUMBERED.search(said):
            return False
    return True


def python(text: str) -> tuple[list[dict], list[tuple[int, int]] | None]:
    """The findings, and the places whose numbers were read: none, or all (None)."""
    v = _Python(text)
    tree = ast.parse(text)
    v.visit(tree)
    v.references()
    return sorted(v.out, key=lambda f: f["line"]), [] if _NUMBERED.search(text) and _blind(v, tree, text) else None


# --- C family -----------------------------------------------------------------------------------------------------------


# Names of the WebCrypto and Node key types.
_WEB = {"RSA-OAEP": "RSA", "RSA-PSS": "RSA", "RSASSA-PKCS1-V1_5": "RSA", "ECDSA": "ECDSA", "ECDH": "ECDH", "HMAC": "HMAC", "PBKDF2": "PBKDF2", "HKDF": "HKDF", "ED25519": "Ed25519", "X25519": "X25519"}
_NODE_KEYS = {"rsa": "RSA", "rsa-pss": "RSA", "dsa": "DSA", "dh": "DH", "ec": "EC", "ed25519": "Ed25519", "ed448": "Ed448", "x25519": "X25519", "x448": "X448"}
_JS_TLS = ("createServer", "createSecureContext", "connect", "request", "get", "Agent", "createSecurePair")


def _suites(listed: str, split: str = ":") -> list[dict]:
    out = []
    for part in listed.split(split):
        part = part.strip().lstrip("!+-")
        if part and (c := N.cipher(part.split("-")[-1] if part.startswith("RC4") else re.sub(r"^(?:TLS_|ECDHE-|DHE-|RSA-|ECDSA-)*", "", part))):
            out.append(c | {"confidence": "medium"})
    return out


def _web(c: Span) -> list[dict]:
    """A WebCrypto call: the algorithm is a string or an object with a name and its parameters."""
    o = c.within(0)
    alg = (literal(o.prop("name")) if o else c.first) or ""
    if d := N.digest(alg):
        return [d]
    size = integer(o.prop("modulusLength") or o.prop("length")) if o else None
    if m := re.fullmatch(r"AES-(\w+)", alg, re.I):
        return [{"family": "AES", "mode": m[1].upper(), "key_size": size}]
    fam = _WEB.get(alg.upper())
    if not fam:
        return []
    inner = N.digest(literal(o.prop("hash")) or literal(o.prop("hash", "name")) or "") if o else None
    curve = N.curve(literal(o.prop("namedCurve"))) if o else None
    more = {"iterations": integer(o.prop("iterations")) if o else None, "hash": inner and (inner.get("name") or inner["family"])}
    f = {"family": fam, "curve": curve, "padding": {"RSA-OAEP": "OAEP", "RSA-PSS": "PSS", "RSASSA-PKCS1-V1_5": "PKCS1v15"}.get(alg.upper()), "extra": more}
    return [f | {"key_size": size if fam in ("RSA", "HMAC") else None}]


def _tls_options(o: Span) -> list[dict]:
    """Versions and cipher lists of an options object."""
    out = []
    for key in ("minVersion", "maxVersion", "secureProtocol"):
        v = literal(o.prop(key))
        if v and (t := N.tls(v.replace("_method", ""))):
            out.append({"family": t, "kind": "protocol", "extra": {"option": key}})
    return out + _suites(literal(o.prop("ciphers")) or "")


def _js(c: Span):
    name = c.name
    last = name.rsplit(".", 1)[-1].removeprefix("new:")
    if last in ("createHash", "createHmac") and (first := c.first) and (d := N.digest(first)):
        return [d if last == "createHash" else {"family": "HMAC", "name": f"HMAC-{d['family']}", "key_size": d["key_size"]}]
    if last in ("createCipheriv", "createDecipheriv", "createCipher", "createDecipher") and (first := c.first) and (f := N.cipher(first)):
        return [f]
    if last in ("pbkdf2", "pbkdf2Sync"):
        d = N.digest(literal(c.arg(4)) or "")
        return [{"family": "PBKDF2", "extra": {"iterations": integer(c.arg(2)), "hash": d and (d.get("name") or d["family"])}}]
    if last in ("scrypt", "scryptSync", "hkdf", "hkdfSync") and ("." in name or last.endswith("Sync")):
        return [{"family": "scrypt" if last.startswith("scrypt") else "HKDF"}]
    if last in ("generateKeyPair", "generateKeyPairSync") and (first := c.first):
        fam, o = _NODE_KEYS.get(first.lower()), c.within(1)
        size, curve = (integer(o.prop("modulusLength")), N.curve(literal(o.prop("namedCurve")))) if o else (None, None)
        return [{"family": fam, "key_size": size, "curve": curve}] if fam else []
    if last == "NodeRSA" and name.startswith("new:"):
        o, args = c.within(0), c.args
        return [{"family": "RSA", "key_size": integer(o.prop("b")) if o else next((v for a in args[:1] if (v := integer(a))), None)}]
    if last in ("createDiffieHellman", "getDiffieHellman"):
        return [{"family": "DH", "key_size": integer(c.args[0]) if last == "createDiffieHellman" and c.args else None}]
    if last == "createECDH":
        return [{"family": "ECDH", "curve": N.curve(c.first)}]
    if last in ("createSign", "createVerify") and (first := c.first):
        d = N.digest(re.sub(r"^RSA-", "", first))
        return [{"family": "RSA", "name": first}] + ([d] if d else []) if first.startswith("RSA") else [d] if d else []
    if ".subtle." in name:
        return _web(c)
    if last in ("sign", "verify") and name.split(".")[0].lower() in ("jwt", "jsonwebtoken", "jose"):
        said = re.findall(r"""['"]((?:[HRPE]S\d{3}K?|EdDSA|none))['"]""", " ".join(c.args))
        return [JWT_NONE if a == "none" else N.jwt(a) for a in said]
    if name.startswith("CryptoJS.") and (f := N.digest(last) or N.cipher(name.split(".")[1])):
        return [f]
    if last in _JS_TLS and (o := next((x for x in c.inner if x.kind == "{"), None)):
        return _tls_options(o)
    return [p] if (p := N.pqc(name)) else []


_JAVA_PAIRS = {"RSA": "RSA", "RSASSA-PSS": "RSA", "EC": "EC", "ECDSA": "EC", "DSA": "DSA", "DH": "DH", "DIFFIEHELLMAN": "DH", "ED25519": "Ed25519", "ED448": "Ed448", "EDDSA": "Ed25519", "X25519": "X25519", "X448": "X448", "XDH": "X25519", "ECDH": "ECDH"}


def _java_instance(owner: str, first: str) -> list[dict]:
    """What ``owner.getInstance(first)`` names."""
    if owner == "Cipher":
        c = N.cipher(first)
        return [c | ({"mode": "ECB"} if c["family"] in ("AES", "DES", "3DES") and not c.get("mode") else {})] if c else []
    if owner == "MessageDigest":
        return [d] if (d := N.digest(first)) else []
    if owner == "Mac":
        d = N.digest(re.sub("^Hmac", "", first))
        return [{"family": "HMAC", "name": first, "key_size": d and d["key_size"]}]
    if owner == "Signature":
        m = re.fullmatch(r"(\w+?)with(\w+?)(?:/\w+)?", first, re.I)
        out = [d] if m and (d := N.digest(m[1])) else []
        fam = {"RSA": "RSA", "ECDSA": "ECDSA", "DSA": "DSA"}.get((m[2] if m else first).upper())
        return out + [{"family": fam or first}]
    if owner in ("KeyPairGenerator", "KeyFactory", "KeyAgreement"):
        fam = _JAVA_PAIRS.get(first.upper())
        return [{"family": fam}] if fam else [p] if (p := N.pqc(first)) else []
    if owner in ("KeyGenerator", "SecretKeyFactory"):
        return [{"family": "PBKDF2"}] if first.startswith("PBKDF2") else [c] if (c := N.cipher(first)) else []
    return [{"family": N.tls(first) or "TLS", "kind": "protocol"}] if owner == "SSLContext" else []


def _java_spec(text: str, curves: dict[str, str]) -> dict:
    """Size and curve of one argument of a generator's init: a number, a parameter object or a variable that holds one."""
    if m := re.search(r"RSAKeyGenParameterSpec\s*\(\s*([\d_]+)", text):
        return {"key_size": integer(m[1])}
    if m := re.search(r"""(?:ECGenParameterSpec|NamedParameterSpec)\s*\(\s*"([^"]+)\"""", text) or re.search(r"NamedParameterSpec\.(\w+)", text):
        return {"curve": N.curve(m[1])}
    if text in curves:
        return {"curve": curves[text]}
    n = integer(text) if re.fullmatch(r"\s*[\dxXa-fA-F_]+\s*", text) else None
    return {"key_size": n} if n is not None and 16 <= n <= 65536 else {}


def _java_file(found: list[Span]):
    """Calls in their order; a generator's size and curve come from the init that follows it, on the variable that took
    it or chained to it, so two generators may be interleaved and a variable used again."""
    made: dict[str, dict] = {}  # variable: the generator it holds
    chained: dict[int, dict] = {}
    curves: dict[str, str] = {}  # variable: the curve of the parameters it holds
    out, loose, bound = [], [], set()
    for c in found:
        parts = c.name.split(".")
        if parts[-1] == "getInstance" and len(parts) > 1:
            if c.first is None:
                continue
            for f in _java_instance(parts[-2], c.first):
                f = dict(f)
                out.append((c.at, f))
                if parts[-2] in ("KeyPairGenerator", "KeyGenerator"):
                    chained[id(c)] = f
                    if c.target:
                        made[c.target] = f
        elif parts[-1] in ("initialize", "init"):
            f = chained.get(id(c.receiver)) if c.receiver is not None else made.get(parts[-2]) if len(parts) > 1 else None
            bound |= {id(x) for x in c.inner} if f else set()
            for a in c.args if f else ():
                told = _java_spec(a, curves)
                f |= told
                if told.get("curve"):
                    loose = [x for x in loose if x[2] not in (a, told["curve"])]
                    if f["family"] in ("X25519", "Ed25519") and told["curve"] in ("x448", "ed448"):
                        f["family"] = told["curve"].title()
        elif c.name == "new:ECGenParameterSpec" and id(c) not in bound and c.first and (k := N.curve(c.first)):
            if c.target:
                curves[c.target] = k
            loose.append((c.at, {"family": "EC", "curve": k, "confidence": "medium"}, c.target or k))
        elif c.name == "new:PBEKeySpec" and len(c.args) > 2:
            out.append((c.at, {"family": "PBKDF2", "extra": {"iterations": integer(c.args[2])}}))
        elif c.name == "new:SecretKeySpec" and len(c.args) > 1 and (k := N.cipher(literal(c.args[-1]) or "")):
            out.append((c.at, k))
        elif parts[-1] in ("setEnabledProtocols", "setProtocols"):
            out += [(c.at, {"family": t, "kind": "protocol"}) for v in re.findall(r'"([^"]+)"', " ".join(c.args)) if (t := N.tls(v))]
        elif parts[-1] in ("setEnabledCipherSuites", "setCipherSuites"):
            out += [(c.at, f) for v in re.findall(r'"([^"]+)"', " ".join(c.args)) for f in _suites(re.sub(r"^TLS_(?:\w+_WITH_)?", "", v))]
    return out + [(at, f) for at, f, _ in loose]


# Constructors of block ciphers and modes in Go's standard library and x/crypto.
_GO_BLOCKS = {"aes.NewCipher": ("AES", None), "des.NewCipher": ("DES", None), "des.NewTripleDESCipher": ("3DES", None), "blowfish.NewCipher": ("Blowfish", None), "cast5.NewCipher": ("CAST5", None)}
_GO_MODES = {"NewGCM": "GCM", "NewGCMWithNonceSize": "GCM", "NewGCMWithTagSize": "GCM", "NewCBCEncrypter": "CBC", "NewCBCDecrypter": "CBC", "NewCTR": "CTR", "NewCFBEncrypter": "CFB", "NewCFBDecrypter": "CFB", "NewOFB": "OFB"}


def _go_file(found: list[Span]):
    """Calls and composites in their order. A block cipher's handle is known by the variable that took it last, and a mode
    built on the handle is that cipher's mode: NewCipher with NewGCM is one finding. A handle that no mode takes, or that two
    take, is one finding or two; a mode on an unknown handle goes to the last one without a variable."""
    handles: dict[str, dict] = {}
    sizes: dict[str, int] = {}
    blocks: list[dict] = []
    out = []
    for c in found:
        pkg, _, fn = c.name.rpartition(".")
        pkg = pkg.rsplit(".", 1)[-1]
        short = f"{pkg}.{fn}"
        if c.kind == "{":
            if short == "tls.Config":
                out += _go_tls(c)
        elif c.name == "make" and c.target and len(c.args) == 2 and (n := integer(c.args[1])):
            sizes[c.target] = n
        elif short in _GO_BLOCKS:
            family, size = _GO_BLOCKS[short]
            n = sizes.get(c.args[0]) if c.args else None
            b = {"at": c.at, "family": family, "key_size": n * 8 if n in (16, 24, 32) and family == "AES" else size, "modes": []}
            blocks.append(b)
            handles[c.target or ""] = b
        elif pkg == "cipher" and fn in _GO_MODES:
            named = [handles[x] for a in c.args if (x := a.strip()) in handles]
            b = named[0] if named else next((handles[""] for _ in [0] if "" in handles), None)
            if b is None:
                out.append((c.at, {"family": "Unknown", "name": f"UNKNOWN (cipher.{fn})", "mode": _GO_MODES[fn], "confidence": "low"}))
            elif _GO_MODES[fn] not in b["modes"]:
                b["modes"].append(_GO_MODES[fn])
        else:
            out += [(c.at, f) for f in _go(c, pkg, fn)]
    for b in blocks:
        out += [(b["at"], {"family": b["family"], "key_size": b["key_size"], "mode": m}) for m in b["modes"] or [None]]
    return out


def _go_tls(c: Span):
    for key in ("MinVersion", "MaxVersion"):
        if t := N.tls((c.prop(key) or "").rsplit(".", 1)[-1].replace("Version", "")):
            yield c.at, {"family": t, "kind": "protocol", "extra": {"option": key}}
    for suite in re.findall(r"tls\.(TLS_\w+)", c.prop("CipherSuites") or ""):
        for f in _suites(re.sub(r"^TLS_(?:\w+_WITH_)?", "", suite)):
            yield c.at, f


def _go(c: Span, pkg: str, fn: str):
    if pkg in ("md5", "sha1", "sha256", "sha512", "sha3", "md4", "ripemd160", "blake2b", "blake2s"):
        m = re.search(r"(\d{3})", fn) if pkg in ("sha512", "sha3") else None
        return [d] if (d := N.digest(f"sha3{m[1]}" if pkg == "sha3" and m else f"sha{m[1]}" if m else pkg)) else []
    if (pkg, fn) in (("rsa", "GenerateKey"), ("rsa", "GenerateMultiPrimeKey")):
        return [{"family": "RSA", "key_size": integer(c.args[-1]) if c.args else None}]
    if (pkg, fn) == ("ecdsa", "GenerateKey"):
        m = re.search(r"elliptic\.(P\d+)", " ".join(c.args))
        return [{"family": "ECDSA", "curve": N.curve(m[1]) if m else None}]
    if pkg == "ed25519":
        return [{"family": "Ed25519"}]
    if fn == "NewCipher" and (k := N.cipher(pkg)):
        return [k]
    if (pkg, fn) == ("hmac", "New"):
        return [{"family": "HMAC"}]
    if pkg in ("chacha20poly1305", "chacha20"):
        return [{"family": "ChaCha20", "key_size": 256}]
    if pkg in ("pbkdf2", "scrypt", "argon2", "hkdf", "bcrypt"):
        n = integer(c.args[2]) if (pkg, fn) == ("pbkdf2", "Key") and len(c.args) > 2 else None
        return [{"family": {"pbkdf2": "PBKDF2", "argon2": "Argon2", "hkdf": "HKDF"}.get(pkg, pkg), "extra": {"iterations": n}}]
    return [p] if (p := N.pqc(c.name)) else []


def _c(c: Span):
    last = c.name.rsplit(".", 1)[-1]
    if m := re.fullmatch(r"EVP_((?:md|sha|blake|ripemd)\w+)", last):
        return [d] if (d := N.digest(m[1].replace("_", ""))) else []
    if (m := re.fullmatch(r"EVP_((?:aes|des|rc4|rc2|bf|chacha20|camellia|aria|cast5|idea)\w*)", last)) and (k := N.cipher(m[1])):
        return [k]
    if m := re.fullmatch(r"(MD[245]|SHA1|SHA224|SHA256|SHA384|SHA512)(?:_(?:Init|Update|Final))?", last):
        return [d] if (d := N.digest(m[1])) else []
    if last in ("RSA_generate_key_ex", "RSA_generate_key", "EVP_PKEY_CTX_set_rsa_keygen_bits"):
        return [{"family": "RSA", "key_size": next((v for a in c.args if (v := integer(a)) and v >= 512 and v != 65537), None)}]
    if last == "EC_KEY_new_by_curve_name":
        m = re.search(r"NID_(?:X9_62_)?(\w+)", c.args[0] if c.args else "")
        return [{"family": "EC", "curve": N.curve(m[1]) if m else None}]
    if last in ("AES_encrypt", "AES_set_encrypt_key", "AES_cbc_encrypt", "AES_ecb_encrypt"):
        return [{"family": "AES", "mode": m[1].upper() if (m := re.search("_(cbc|ecb)_", last)) else None}]
    if re.match(r"DES_(?:ede3|ecb3)", last) or last.startswith("DES_"):
        return [{"family": "3DES" if "3" in last else "DES"}]
    if m := re.fullmatch(r"((?:TLS|SSL|DTLS)v?[\d_]*)_(?:client_|server_)?method", last):
        return [{"family": N.tls(m[1]) or "TLS"}]
    if last.startswith("OQS_"):
        return [p] if (p := N.pqc(" ".join([last, *c.args]))) else []
    if last in ("HMAC", "HMAC_Init_ex"):
        return [{"family": "HMAC"}]
    return [p] if (p := N.pqc(last)) else []


_each = lambda rule: lambda found: [(c.at, f) for c in found for f in rule(c)]
_FILES = {"js": _each(_js), "java": _java_file, "go": _go_file, "c": _each(_c)}
CALLS = 20_000
_BREAK = re.compile("\n")
_IMPORTS = {
    "go": (r'"(crypto/(?:md5|sha1|des|rc4|rsa|ecdsa|ed25519|aes|sha256|sha512)|golang\.org/x/crypto/\w+)"', lambda p: N.digest(p.rsplit("/", 1)[-1]) or N.cipher(p.rsplit("/", 1)[-1])),
    "c": (r"#\s*include\s*[<\"]((?:openssl|oqs|mbedtls|sodium|wolfssl)[^>\"]*)[>\"]", lambda p: {"family": {"oqs": "liboqs", "mbedtls": "mbedTLS", "sodium": "libsodium", "wolfssl": "wolfSSL"}.get(p.split("/")[0].split(".")[0], "OpenSSL"), "kind": "library"}),
}


_DIGITS = re.compile("[0-9]{6}")


def c_family(text: str, lang: str) -> tuple[list[dict], list[tuple[int, int]] | None]:
    """Findings of calls in live code; strings that are thrown or logged are no calls, comments aren't seen. And the places of the text that
    rules looked at: None is all of it, as where names with long numbers are compared or looked into. In C rules look into every name."""
    code, live = masked(text, lang)
    starts = [0, *(m.end() for m in _BREAK.finditer(text))]
    line = lambda at: bisect.bisect_right(starts, at)
    starts_next = [*starts[1:], len(text) + 1]
    shown = lambda at: text[starts[line(at) - 1] : starts_next[line(at) - 1] - 1]
    out = []
    reads: list[tuple[int, int]] = []
    every = spans(code, live, reads)
    found = [x for x in every if x.name and (x.kind == "(" or (x.kind == "{" and lang == "go"))][:CALLS]
    for at, f in sorted(_FILES[lang](found), key=lambda x: x[0]):
        if f and f.get("family"):
            kind = "protocol" if f["family"].startswith(("TLS", "SSL")) else "algorithm"
            out.append(_finding(line(at), shown(at), lang, f, kind=kind))
    seen = {f["family"] for f in out}
    if lang in _IMPORTS:
        pattern, told = _IMPORTS[lang]
        for m in re.finditer(pattern, live):
            reads.append(m.span())
            f = told(m[1])
            if f and f["family"] not in seen:  # an import alone counts only where no call covers it
                out.append(_finding(line(m.start()), shown(m.start()), lang, f, confidence="high" if f.get("kind") else "medium", kind=f.get("kind", "algorithm")))
    blind = lang != "c" and not any((x.target and _DIGITS.search(x.target)) or (x.name and "." in x.name and _DIGITS.search(x.name)) for x in every)
    return out, reads if blind else None


def detect(lang: str, text: str) -> tuple[list[dict], str | None]:
    """``(findings, error)`` of one file; a text that can't be parsed is an error, never an exception."""
    return traced(lang, text)[:2]


def traced(lang: str, text: str) -> tuple[list[dict], str | None, list[tuple[int, int]] | None]:
    """``detect``, and the places of the text whose digits its findings may depend on (None: all)."""
    try:
        found, reads = python(text) if lang == "python" else c_family(text, lang)
        return found, None, reads
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], f"{type(e).__name__}: {e}", None
