"""Parsers of cryptographic names as column expressions: cipher suites, OpenSSL ciphers, JCA transformations, JWT
algorithms, TLS versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suite(name: Column) -> dict[str, Column]:
    """Parts of a TLS 1.3, IANA or OpenSSL cipher suite name."""
    n = F.upper(F.regexp_replace(name, "-", "_"))
    tls13 = n.rlike("^TLS_(?:AES|CHACHA20|SM4)_")
    kex = (
        F.when(tls13, "ECDHE")
        .when(n.rlike("ECDHE"), "ECDHE")
        .when(n.rlike("(?:^|_)(?:DHE|EDH)(?:_|$)"), "DHE")
        .when(n.rlike("(?:^|_)(?:ADH|DH_ANON)"), "DH")
        .when(n.rlike("(?:^|_)ECDH_"), "ECDH")
        .when(n.rlike("(?:^|_)DH_"), "DH")
        .when(n.rlike("(?:^|_)PSK"), "PSK")
        .otherwise("RSA")
    )
    anonymous = n.rlike("ANON|(?:^|_)ADH|(?:^|_)AECDH")
    auth = F.when(anonymous, "none").when(tls13, "certificate").when(n.rlike("ECDSA"), "ECDSA").when(n.rlike("DSS"), "DSS").when(n.rlike("(?:^|_)PSK") & ~n.rlike("RSA"), "PSK").otherwise("RSA")
    bulk = (
        F.when(n.rlike("CHACHA20"), "ChaCha20")
        .when(n.rlike("AES"), "AES")
        .when(n.rlike("CAMELLIA"), "Camellia")
        .when(n.rlike("ARIA"), "ARIA")
        .when(n.rlike("3DES|DES_CBC3"), "3DES")
        .when(n.rlike("RC4"), "RC4")
        .when(n.rlike("DES"), "DES")
        .when(n.rlike("NULL"), "NULL")
        .otherwise("unknown")
    )
    bits = F.when(bulk == "ChaCha20", 256).when(bulk == "3DES", 168).when(bulk == "DES", 56).when(bulk == "NULL", 0).otherwise(F.expr("NULL").cast("int"))
    size = F.regexp_extract(n, "(?:AES|CAMELLIA|ARIA|RC4)_?([0-9]{2,3})", 1)
    bits = F.coalesce(F.when(size != "", size.cast("int")), bits)
    mode = F.when(bulk == "ChaCha20", "Poly1305").when(n.rlike("GCM"), "GCM").when(n.rlike("CCM"), "CCM").when(bulk.isin("RC4", "NULL"), None).otherwise("CBC")
    mac = F.when(n.rlike("SHA384$"), "SHA-384").when(n.rlike("SHA256$"), "SHA-256").when(n.rlike("MD5$"), "MD5").when(n.rlike("SHA$"), "SHA-1")
    return {"kex": kex, "auth": auth, "bulk": bulk, "bits": bits.cast("int"), "mode": mode, "mac": mac, "aead": F.coalesce(mode.isin("GCM", "CCM", "Poly1305"), F.lit(False)), "forward_secrecy": kex.isin("ECDHE", "DHE"), "anonymous": anonymous}


def openssl_cipher(name: Column) -> dict[str, Column]:
    """``aes-256-gcm`` and the like: family, key size, mode."""
    n = F.lower(F.trim(name))
    family = F.when(n.rlike("^aes"), "AES").when(n.rlike("^(?:des-?ede3?|des3|3des)"), "3DES").when(n.rlike("^des"), "DES").when(n.rlike("^(?:rc4|arc4)"), "RC4").when(n.rlike("^camellia"), "Camellia").when(n.rlike("^chacha20"), "ChaCha20").when(n.rlike("^(?:bf|blowfish)"), "Blowfish").when(n.rlike("^aria"), "ARIA").when(n.rlike("^(?:cast)"), "CAST5").when(n.rlike("^idea"), "IDEA").when(n.rlike("^sm4"), "SM4")
    size = F.regexp_extract(n, "^(?:id-)?[a-z]+-?([0-9]{3})(?:-|$)", 1)
    size = F.when(family == "ChaCha20", 256).when(family == "3DES", 168).when(family == "DES", 56).when(size != "", size.cast("int"))
    mode = F.regexp_extract(n, "-(cbc|gcm|ctr|ecb|ccm|ofb|cfb|xts|ocb|siv|wrap|poly1305)[0-9]*$", 1)
    return {"family": family, "key_size": size.cast("int"), "mode": F.when(mode != "", F.upper(mode))}


def java_transformation(name: Column) -> dict[str, Column]:
    """``AES/GCM/NoPadding``: family, mode (ECB where the provider's default applies), padding."""
    parts = F.split(F.trim(name), "/")
    head = F.upper(F.get(parts, F.lit(0)))
    family = F.when(head.rlike("^AES"), "AES").when(head.isin("DESEDE", "TRIPLEDES", "3DES"), "3DES").when(head == "DES", "DES").when(head.rlike("^RSA"), "RSA").when(head.isin("RC4", "ARCFOUR"), "RC4").when(head == "BLOWFISH", "Blowfish").when(head.rlike("^CHACHA20"), "ChaCha20").when(head.rlike("^PBE"), "PBE").otherwise(head)
    size = F.regexp_extract(head, "_([0-9]{3})$", 1)
    given = F.upper(F.get(parts, F.lit(1)))
    mode = F.when(family == "RSA", None).when(given.isNotNull(), given).when(family.isin("AES", "DES", "3DES", "Blowfish"), "ECB")
    return {"family": family, "key_size": F.when(size != "", size.cast("int")).cast("int"), "mode": mode, "padding": F.get(parts, F.lit(2))}


def jwt(alg: Column) -> dict[str, Column]:
    a = F.upper(F.trim(alg))
    n = F.regexp_extract(a, "([0-9]{3})", 1)
    family = F.when(a == "NONE", "none").when(a.rlike("^HS"), "HMAC").when(a.rlike("^(?:RS|PS)[0-9]|^RSA"), "RSA").when(a.rlike("^ES"), "ECDSA").when(a == "EDDSA", "Ed25519").when(a.rlike("^ECDH"), "ECDH").when(a.rlike("^A[0-9]{3}"), "AES").when(a == "DIR", "direct").otherwise("unknown")
    curve = F.when(a == "ES256", "secp256r1").when(a == "ES384", "secp384r1").when(a == "ES512", "secp521r1").when(a == "ES256K", "secp256k1").when(a == "EDDSA", "ed25519")
    return {"family": family, "hash": F.when(a.rlike("^(?:HS|RS|PS|ES)[0-9]") & (n != ""), F.concat(F.lit("SHA-"), n)), "padding": F.when(a.rlike("^PS[0-9]"), "PSS").when(a.rlike("^RS[0-9]"), "PKCS1v15"), "curve": curve}


def tls_version(c: Column) -> Column:
    n = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.when(n.rlike("tls(?:v)?1?3$|tlsv13|tls13"), "TLSv1.3").when(n.rlike("tlsv?12"), "TLSv1.2").when(n.rlike("tlsv?11"), "TLSv1.1").when(n.rlike("sslv?3"), "SSLv3").when(n.rlike("sslv?2(?:$|[^3])"), "SSLv2").when(n.rlike("tlsv?1(?:0)?$|tlsv?10"), "TLSv1.0").when(n.rlike("tls|ssl"), "TLS (unpinned)")


def hash_name(c: Column) -> dict[str, Column]:
    """Family and digest size of a hash's name; an HMAC prefix or a signature suffix is dropped."""
    n = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "with[a-z0-9]*$", ""), "^hmac[-_]?", ""), "[-_/ ]", "")
    family = F.when(n.rlike("^sha3|^keccak"), "SHA-3").when(n.rlike("^shake"), "SHAKE").when(n.rlike("^sha(?:224|256|384|512)|^sha2"), "SHA-2").when(n.rlike("^sha1$|^sha$|^sha160$"), "SHA-1").when(n.rlike("^md[245]"), F.upper(F.left(n, F.lit(3)))).when(n.rlike("^blake2"), "BLAKE2").when(n.rlike("^blake3"), "BLAKE3").when(n.rlike("^(?:ripemd|rmd)"), "RIPEMD").when(n.rlike("^sm3"), "SM3")
    size = F.regexp_extract(n, "(128|160|224|256|384|512)$", 1)
    return {"family": family, "digest_size": F.when(family == "SHA-1", 160).when(family.isin("MD2", "MD4", "MD5"), 128).when((size != "") & (family != "SHAKE"), size.cast("int")).cast("int")}
