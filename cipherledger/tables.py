"""Editable tables of the inventory: families, aliases, rules, policy defaults. Extending the engine means adding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Default verdict by family. threat -> category -> families.
FAMILIES = {
    "shor_broken": {
        "asymmetric": ["RSA", "DSA", "DH", "ECDSA", "ECDH", "EC", "X25519", "X448", "Ed25519", "Ed448", "ElGamal", "ECIES", "ECMQV", "SM2", "Paillier", "BLS", "RSASSA-PSS", "RSAES-OAEP", "DSS"],
        "protocol": ["SSH", "IPsec", "WireGuard", "TLS1.2", "TLS1.3"],
        "padding": ["OAEP"],
    },
    "legacy_broken": {
        "hash": ["MD5", "MD4", "MD2", "SHA-0", "SHA-1", "CRC32", "RIPEMD"],
        "symmetric": ["DES", "3DES", "RC4", "RC2", "Blowfish", "RC5", "IDEA", "TEA", "CAST5", "null-cipher", "export-cipher"],
        "kdf": ["md5crypt"],
        "prng": ["weak-prng"],
        "protocol": ["anon-kex", "SSLv2", "SSLv3", "TLS1.0", "TLS1.1"],
        "asymmetric": ["SIKE", "Rainbow"],
        "mode": ["ECB"],
        "padding": ["PKCS1v15", "no-padding"],
    },
    "grover_weakened": {"symmetric": ["SEED", "SM4"], "hash": ["Whirlpool"], "protocol": ["Kerberos"], "mode": ["CBC"]},
    "quantum_safe": {
        "symmetric": ["AES", "Camellia", "ARIA", "ChaCha20", "XChaCha20", "Salsa20"],
        "hash": ["SHA-2", "SHA-3", "SHAKE", "BLAKE2", "BLAKE3"],
        "mac": ["HMAC", "CMAC", "GMAC", "Poly1305"],
        "kdf": ["PBKDF2", "bcrypt", "scrypt", "Argon2", "HKDF"],
        "mode": ["CTR", "GCM", "CCM", "SIV", "OCB", "XTS"],
    },
    "pqc": {"asymmetric": ["ML-KEM", "ML-DSA", "SLH-DSA", "Falcon", "HQC", "BIKE", "Classic-McEliece", "XMSS", "LMS", "NTRU", "FrodoKEM"]},
    "unknown": {"protocol": ["JWT"]},
}

# Spellings that no rule derives from the family's own name.
ALIASES = {
    "rsa": "rsaencryption ssh-rsa rs256 rs384 rs512 ps256 ps384 ps512 pkcs1 rsakey",
    "dsa": "dsakey ssh-dss",
    "dh": "dhe edh diffie-hellman dhparam modp ffdhe",
    "ecdsa": "es256 es384 es512 es256k ecdsa-sha2",
    "ecdh": "ecdhe",
    "ec": "ecc elliptic-curve id-ecpublickey eckey",
    "x25519": "curve25519",
    "x448": "curve448",
    "ed25519": "eddsa edwards25519 ssh-ed25519",
    "ed448": "edwards448",
    "ecmqv": "mqv",
    "md4": "ntlm",
    "sha-1": "sha sha-160 hmac-sha1",
    "des": "single-des",
    "3des": "des3 desede triple-des des-ede3 tdea",
    "rc4": "arc4 arcfour",
    "blowfish": "bf",
    "tea": "xtea xxtea",
    "cast5": "cast cast-128",
    "crc32": "crc adler32",
    "weak-prng": "math-random mt19937 mersenne-twister java-util-random rand srand",
    "null-cipher": "null enull",
    "export-cipher": "export exp",
    "anon-kex": "anon adh anull",
    "aes": "rijndael aes-gcm aes-cbc aes-ecb aes-ctr aes-wrap",
    "sm4": "sms4",
    "chacha20": "chacha chacha20-poly1305",
    "sha-2": "sha-224 sha-256 sha-384 sha-512",
    "sha-3": "keccak",
    "ripemd": "rmd160",
    "hmac": "hs256 hs384 hs512",
    "ml-kem": "kyber crystals-kyber x25519mlkem768 fips203",
    "ml-dsa": "dilithium crystals-dilithium fips204",
    "slh-dsa": "sphincs sphincsplus fips205",
    "falcon": "fn-dsa",
    "classic-mceliece": "mceliece",
    "lms": "hss",
    "ntru": "sntrup761",
    "frodokem": "frodo",
    "sike": "sidh",
    "tls1-0": "tlsv1",
    "ipsec": "ikev2 ike isakmp",
    "wireguard": "wg",
    "kerberos": "krb5 gssapi",
    "jwt": "jws jwe",
    "ctr": "ofb cfb",
    "ccm": "eax",
    "siv": "gcm-siv",
    "no-padding": "textbook-rsa",
}

SEVERITIES = {"critical": 4, "high": 3, "medium": 2, "low": 1, "none": 0}
CLASS_YEARS = {"classified": 40, "health": 30, "pii": 25, "financial": 15, "credential": 12, "default": 10, "internal": 5, "session_key": 1, "public": 0}
FAMILY_YEARS = {"RSA": 3, "ECDSA": 3, "ECDH": 3, "DH": 3, "AES": 1, "SHA-2": 1, "TLS": 2}
DEFAULT_YEARS, QUANTUM_YEAR = 3, 2035
LABELS = [("critical", 1.0), ("high", 0.8), ("medium", 0.55), ("low", 0.3), ("none", 0.15)]

# The default policy's path rules, in order; the last that matches wins.
_dirs = lambda names, value: [(f"**/{n}/**", value) for n in names.split()]
CLASS_RULES = [
    ("**", "default"),
    *_dirs("session sessions cache ephemeral tmp", "session_key"),
    *_dirs("public static assets docs examples", "public"),
    *_dirs("internal telemetry metrics", "internal"),
    *_dirs("payment payments billing ledger txn transactions upi settlement", "financial"),
    *_dirs("user users customer customers profile kyc aadhaar pan biometric subscriber", "pii"),
    *_dirs("health medical patient ehr", "health"),
    *_dirs("auth identity secrets vault keystore keys", "credential"),
    *[(f"*.{x}", "credential") for x in ("pem", "key", "p12", "pfx", "jks")],
    *_dirs("classified restricted defence sigint", "classified"),
]
CRITICALITY_RULES = [
    ("**", 0.3),
    *_dirs("payment payments settlement upi", 1.0),
    *_dirs("billing ledger", 0.95),
    *_dirs("auth login identity sso", 0.9),
    *_dirs("session crypto security kms pki", 0.85),
    *_dirs("tls", 0.8),
    *_dirs("api core server gateway", 0.7),
    *_dirs("db database", 0.6),
    *_dirs("scripts tools", 0.2),
    *_dirs("test tests testdata fixtures mock mocks examples sample samples", 0.1),
    *_dirs("docs", 0.05),
    *[(f"*.{x}", 1.0) for x in ("pem", "key", "p12", "pfx", "jks")],
    *_dirs("keys secrets keystore vault", 1.0),
    ("*signing*", 0.95),
    ("*license*", 0.9),
]
IGNORED_DIRS = "node_modules vendor third_party dist build out target .git .venv venv env __pycache__ .tox site-packages .mypy_cache .pytest_cache .idea .vscode coverage".split()

# The flat scanner's rules, for lower-cased text: id, whole words, parts of words, algorithm, tier, advice.
_FLAT = [
    ("rsa", "rsa", "", "RSA", "BROKEN_Q", "ML-KEM-768 (encryption) / ML-DSA-65 (signatures), hybrid"),
    ("ecdsa", "ecdsa|es256|secp256k1|p-256", "signingkey", "ECDSA", "BROKEN_Q", "ML-DSA-65 (signatures)"),
    ("ecdh", "ecdh", "x25519|curve25519|derivebits|diffiehellman", "ECDH/X25519", "BROKEN_Q", "ML-KEM-768 (hybrid key exchange)"),
    ("dh", "diffie[- ]?hellman|dhparameter[a-z0-9_]*", "", "Diffie-Hellman", "BROKEN_Q", "ML-KEM-768 (hybrid)"),
    ("md5", "md5", "", "MD5", "WEAK", "SHA-256 / SHA-3"),
    ("sha1", "sha-?1", "", "SHA-1", "WEAK", "SHA-256 / SHA-3"),
    ("des", "3?des", "des3|pydes", "DES/3DES", "WEAK", "AES-256-GCM"),
    ("rc4", "rc4", "arc4", "RC4", "WEAK", "AES-256-GCM"),
    ("aes", "aes-?256", r"aes\.new|algorithms\.aes", "AES-256", "SAFE", "No change needed"),
    ("sha256", "sha-?(?:256|384|512|3)", r"hashlib\.sha(?:256|384|512|3)", "SHA-256+", "SAFE", "No change needed"),
    ("mlkem", "ml-kem|kyber", "ml_kem|mlkem", "ML-KEM", "PQC", "Already quantum-safe"),
    ("mldsa", "ml-dsa|dilithium", "ml_dsa|mldsa", "ML-DSA", "PQC", "Already quantum-safe"),
    ("slhdsa", "slh-?dsa", "sphincs", "SLH-DSA", "PQC", "Already quantum-safe"),
]
#: By rule: its whole words and its parts of words.
FLAT_WORDS = {r: (words, parts) for r, words, parts, *_ in _FLAT}
#: (rule, pattern, algorithm, tier, advice).
FLAT_RULES = [(r, f"(?:^|[^a-z0-9_])(?:{words})(?:$|[^a-z0-9_])" + (f"|{parts}" if parts else ""), *rest) for r, words, parts, *rest in _FLAT]
TIERS = ["BROKEN_Q", "WEAK", "SAFE", "PQC"]

# Advice by rule id (recommendation, standard).
ADVICE = {
    "KEM_HYBRID": ("Hybrid X25519 + ML-KEM-768 key establishment", "FIPS 203"),
    "SIG_MLDSA": ("ML-DSA-65 signatures", "FIPS 204"),
    "SIG_SLHDSA": ("SLH-DSA signatures for long-lived roots of trust", "FIPS 205"),
    "AMBIGUOUS_USAGE": ("Decide whether the key signs or establishes keys, then ML-DSA-65 or ML-KEM-768", "FIPS 203/204"),
    "HASH_SHA256": ("SHA-256, SHA-384 for long-lived data", "FIPS 180-4"),
    "CIPHER_AES256": ("AES-256-GCM", "SP 800-38D"),
    "AES128_UPGRADE": ("AES-256", "FIPS 197"),
    "SHA256_TO_384": ("SHA-384", "FIPS 180-4"),
    "ECB_TO_GCM": ("AES-256-GCM in place of ECB", "SP 800-38D"),
    "UNAUTH_MODE_TO_AEAD": ("An authenticated mode (GCM, CCM)", "SP 800-38D"),
    "PKCS1V15_TO_OAEP": ("OAEP padding now, ML-KEM-768 next", "RFC 8017"),
    "TLS_13": ("TLS 1.3", "RFC 8446"),
    "TLS13_HYBRID_GROUP": ("TLS 1.3 with the X25519MLKEM768 group", "RFC 8446"),
    "PQC_OK": ("No change needed: already post-quantum", "FIPS 203-205"),
    "QSAFE_OK": ("No change needed", "-"),
    "REMOVE_BROKEN_PQC": ("Remove: broken scheme", "-"),
    "UNKNOWN": ("Review by hand", "-"),
}

# Crypto packages (ecosystem, name, family, hint, version floor).
PACKAGES = [
    ("pypi", "cryptography", "OpenSSL", "shor_broken", "42.0.0"), ("pypi", "pycryptodome", "PyCryptodome", "shor_broken", "3.19.1"), ("pypi", "pycrypto", "PyCrypto", "legacy_broken", None),
    ("pypi", "pynacl", "libsodium", "shor_broken", None), ("pypi", "rsa", "RSA", "shor_broken", "4.7"), ("pypi", "ecdsa", "ECDSA", "shor_broken", None), ("pypi", "pyjwt", "JWT", "shor_broken", "2.4.0"),
    ("pypi", "paramiko", "SSH", "shor_broken", "3.4.0"), ("pypi", "bcrypt", "bcrypt", "quantum_safe", None), ("pypi", "argon2-cffi", "Argon2", "quantum_safe", None), ("pypi", "liboqs-python", "liboqs", "pqc", None),
    ("npm", "node-rsa", "RSA", "shor_broken", None), ("npm", "elliptic", "EC", "shor_broken", "6.5.4"), ("npm", "crypto-js", "CryptoJS", "grover_weakened", "4.2.0"), ("npm", "jsonwebtoken", "JWT", "shor_broken", "9.0.0"),
    ("npm", "node-forge", "forge", "shor_broken", "1.3.0"), ("npm", "md5", "MD5", "legacy_broken", None), ("npm", "tweetnacl", "NaCl", "shor_broken", None), ("npm", "bcryptjs", "bcrypt", "quantum_safe", None),
    ("maven", "bcprov-jdk18on", "BouncyCastle", "shor_broken", "1.78"), ("maven", "jjwt", "JWT", "shor_broken", None), ("maven", "tink", "Tink", "shor_broken", None),
    ("go", "golang.org/x/crypto", "x/crypto", "shor_broken", "0.17.0"), ("go", "github.com/golang-jwt/jwt", "JWT", "shor_broken", None), ("go", "github.com/cloudflare/circl", "CIRCL", "pqc", None),
    ("cargo", "rsa", "RSA", "shor_broken", None), ("cargo", "ring", "ring", "shor_broken", "0.17.0"), ("cargo", "openssl", "OpenSSL", "shor_broken", "0.10.55"), ("cargo", "pqcrypto", "PQClean", "pqc", None),
]


# Words in package names that tell a post-quantum scheme, by its family.
PQC_WORDS = {
    "ML-KEM": "kyber mlkem frodo frodokem ntru saber mceliece bike hqc",
    "ML-DSA": "dilithium mldsa falcon rainbow picnic",
    "SLH-DSA": "sphincs slhdsa xmss",
    "PQC": "liboqs oqs pqcrypto pqclean postquantum pqc",
}


def slug(name: str) -> str:
    """The driver-side twin of ``functions.text.slug``."""
    import re

    s = re.sub(r"[\s_.:]+", "-", name.strip().lower().rsplit("/", 1)[-1])
    return re.sub("-+", "-", s).strip("-")


def alias_rows() -> list[tuple[str, str]]:
    """``(alias, family)``: own names, their spellings without hyphens, the listed aliases in both spellings, and sized
    forms (SHA-2 256, AES-128 ...) by rule. The first family that claims a spelling keeps it."""
    own = {slug(f): f for by in FAMILIES.values() for fs in by.values() for f in fs}
    out: dict[str, str] = {}
    for s, f in own.items():
        out.setdefault(s, f)
    for s, more in ALIASES.items():
        for a in more.split():
            out.setdefault(a, own[s])
    sized = {"AES": (128, 192, 256), "RSA": (1024, 2048, 3072, 4096), "Camellia": (128, 192, 256), "SHA-3": (224, 256, 384, 512), "SHAKE": (128, 256), "ML-KEM": (512, 768, 1024), "ML-DSA": (44, 65, 87), "HMAC": ("md5", "sha256", "sha384", "sha512")}
    for f, sizes in sized.items():
        for n in sizes:
            out.setdefault(f"{slug(f)}-{n}", f)
    for a, f in list(out.items()):
        out.setdefault(a.replace("-", ""), f)
    return sorted(out.items())


def families(spark: SparkSession) -> DataFrame:
    rows = [(f, c, t) for t, by in FAMILIES.items() for c, fs in by.items() for f in fs]
    return spark.createDataFrame(rows, "kb_family string, category string, base_threat string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(alias_rows(), "alias string, kb_family string")


def packages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PACKAGES, "ecosystem string, package string, family string, hint string, floor string")


def advice(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in ADVICE.items()], "rule_id string, recommendation string, standard string")
