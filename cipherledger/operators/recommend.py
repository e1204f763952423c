"""Recommendations: a rule id for each asset, its advice, and mechanical patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..runtime import ship

LONG_TERM = 20


def rule(family: Column, threat: Column, size: Column, mode: Column, x_years: Column, usage: Column | None = None) -> Column:
    """The id of the rule that applies; ``usage`` is sign, kex or null."""
    mode = F.upper(F.coalesce(mode, F.lit("")))
    usage = F.coalesce(usage, F.lit("")) if usage is not None else F.lit("")
    sign = F.when(x_years >= LONG_TERM, "SIG_SLHDSA").otherwise("SIG_MLDSA")
    return (
        F.when(family.isin("SIKE", "Rainbow"), "REMOVE_BROKEN_PQC")
        .when(threat == "pqc", "PQC_OK")
        .when(family.isin("ECDSA", "Ed25519", "Ed448", "DSA", "DSS"), sign)
        .when(family.isin("DH", "ECDH", "X25519", "X448", "ElGamal", "ECIES", "ECMQV"), "KEM_HYBRID")
        .when(family.isin("RSA", "EC", "SM2"), F.when(usage == "sign", sign).when(usage == "kex", "KEM_HYBRID").otherwise("AMBIGUOUS_USAGE"))
        .when(family.isin("PKCS1v15"), "PKCS1V15_TO_OAEP")
        .when(family.isin("SSLv2", "SSLv3", "TLS1.0", "TLS1.1"), "TLS_13")
        .when(family.isin("TLS1.2", "TLS1.3"), "TLS13_HYBRID_GROUP")
        .when(family.isin("MD5", "MD4", "MD2", "SHA-0", "SHA-1", "RIPEMD", "CRC32"), "HASH_SHA256")
        .when(mode == "ECB", "ECB_TO_GCM")
        .when(family.isin("DES", "3DES", "RC4", "RC2", "Blowfish", "RC5", "IDEA", "TEA", "CAST5"), "CIPHER_AES256")
        .when(family.isin("AES", "Camellia", "ARIA") & (F.coalesce(size, F.lit(0)) < 256), "AES128_UPGRADE")
        .when(mode.isin("CBC", "CTR"), "UNAUTH_MODE_TO_AEAD")
        .when((family == "SHA-2") & (size < 384), "SHA256_TO_384")
        .when(threat == "quantum_safe", "QSAFE_OK")
        .otherwise("UNKNOWN")
    )


def advised(assets: DataFrame, usage: Column | None = None) -> DataFrame:
    """``assets`` with ``rule_id, recommendation, standard`` and a rationale that names how much was seen and where first. What an
    asset is used for is its column ``usage`` if it has one."""
    usage = F.col("usage") if usage is None and "usage" in assets.columns else usage
    r = assets.withColumn("rule_id", rule(F.col("kb_family"), F.col("threat"), F.col("key_size"), F.col("mode"), F.col("x_years"), usage))
    out = r.join(F.broadcast(T.advice(assets.sparkSession)), "rule_id", "left")  # a fixed table
    why = F.concat(F.col("family"), F.lit(" seen "), F.col("n_occ").cast("string"), F.lit(" times in "), F.col("n_files").cast("string"), F.lit(" files, first at "), F.col("file"), F.lit(":"), F.col("line").cast("string"))
    return out.withColumn("rationale", why)


# Mechanical rewrites (rule, families, pattern, replacement), for Python's re. Only those that keep the program
# sound: other key lengths, modes that need a nonce, and C digests, whose callers hold buffers of the old length, aren't swapped.
FIXES = [
    ("hash.md5", ["MD5"], r"\bhashlib\.md5\(", "hashlib.sha256("),
    ("hash.sha1", ["SHA-1"], r"\bhashlib\.sha1\(", "hashlib.sha256("),
    ("hash.new", ["MD5", "SHA-1"], r"\bhashlib\.new\((['\"])(?:md5|sha1)\1", r"hashlib.new(\1sha256\1"),
    ("node.hash", ["MD5", "SHA-1"], r"\bcreateHash\((['\"])(?:md5|sha1)\1\)", r"createHash(\1sha256\1)"),
    ("java.digest", ["MD5", "SHA-1"], r"MessageDigest\.getInstance\(\"(?:MD5|SHA-?1)\"\)", 'MessageDigest.getInstance("SHA-256")'),
    ("go.md5", ["MD5"], r"\bmd5\.New\(\)", "sha256.New()"),
    ("go.sha1", ["SHA-1"], r"\bsha1\.New\(\)", "sha256.New()"),
    ("tls.version", ["TLS1.0", "TLS1.1", "TLS"], r"\bTLSVersion\.TLSv1(?:_1)?\b", "TLSVersion.TLSv1_3"),
]
#: Near a pinned digest (three lines either way) a hash isn't swapped.
PINNED = r"(?i)checksum|fingerprint|etag|content-md5|legacy|compat"
MAX_FILES = 25
PARTS = 64


SHORTEST = 4  # characters of evidence that can find a line again


def rewritable(family: Column, line: Column) -> Column:
    """Whether a mechanical rewrite of the family fits a line."""
    out = F.lit(False)
    for _, families, pattern, _ in FIXES:
        out = out | (family.isin(families) & line.rlike(pattern))
    return out


def located(sites: DataFrame, lines: DataFrame) -> DataFrame:
    """``sites (file, line, evidence, family, ...)`` with ``at``: the line of ``lines (file, line, text)`` where a rewrite belongs. The
    recorded line counts if a rewrite still fits it; else the file's only line that holds the evidence, if one fits that; otherwise, and
    where several hold it, null. Both joins are by file; lines that no rewrite fits, which are most, only count as holders."""
    keyed = sites.withColumn("site", F.monotonically_increasing_id())
    l = lines.select(F.col("file").alias("l_file"), F.col("line").alias("l_line"), F.col("text").alias("l_text"))
    said = F.trim(F.coalesce("evidence", F.lit("")))
    here = (F.col("l_line") == F.col("line")) & rewritable(F.col("family"), F.col("l_text"))
    holds = (F.length(said) >= SHORTEST) & F.contains("l_text", said)
    met = keyed.select("site", "file", "line", "evidence", "family").join(l, (F.col("file") == F.col("l_file")) & (here | holds))
    fits = rewritable(F.col("family"), F.col("l_text"))
    g = met.groupBy("site").agg(F.max(F.when(here, F.col("l_line"))).alias("own"), F.count_if(holds).alias("n"), F.max(F.when(holds & fits, F.col("l_line"))).alias("other"))
    at = F.coalesce("own", F.when(F.col("n") == 1, F.col("other")))
    return keyed.join(g, "site", "left").select(*sites.columns, at.alias("at"))


def patches(places: DataFrame, files: DataFrame) -> DataFrame:
    """``asset_key, file, patch``: unified diffs for ``places (asset_key, family, file, line)`` that a rewrite fits, of at most
    ``MAX_FILES`` files an asset, the first by name: those of parts of an asset's files first, then of these, so no task takes all
    files of an asset. Each (asset, file) is one call: the text of one file."""
    ship(places.sparkSession)
    from pyspark.sql import Window

    first = lambda x, *by: x.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("file"))).where(F.col("r") <= MAX_FILES).drop("r")
    each = places.select("asset_key", "file").distinct().withColumn("part", F.pmod(F.xxhash64("file"), F.lit(PARTS)))
    some = places.join(first(first(each, "asset_key", "part").drop("part"), "asset_key"), ["asset_key", "file"], "left_semi")
    sites = some.groupBy("asset_key", "family", "file").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    with_text = sites.join(files.select(F.col("path").alias("file"), "text"), "file")

    @F.pandas_udf("string")
    def patch(family, file, lines, text):
        return __import__("pandas").Series([one_patch(*x) for x in zip(family, file, lines, text)], dtype=object)

    return with_text.select("asset_key", "file", patch("family", "file", "lines", "text").alias("patch")).where("patch is not null")


def one_patch(family: str, file: str, lines, text: str) -> str | None:
    import difflib
    import re

    old = text.split("\n")
    new = list(old)
    for n in lines:
        i = int(n) - 1
        if not 0 <= i < len(old):
            continue
        for name, families, pattern, swap in FIXES:
            near = "\n".join(old[max(0, i - 3) : i + 4])
            if family in families and not (name.split(".")[1] in ("md5", "sha1", "new", "hash", "digest") and re.search(PINNED, near)):
                new[i] = re.sub(pattern, swap, new[i])
    if new == old:
        return None
    return "\n".join(difflib.unified_diff(old, new, f"a/{file}", f"b/{file}", lineterm="", n=3)) + "\n"
