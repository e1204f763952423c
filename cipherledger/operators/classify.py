"""Classification of assets against the knowledge base, as joins and CASE expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import text as X


def resolved(found: DataFrame, family: str = "family") -> DataFrame:
    """``found`` with ``kb_family``: by alias of the slug, else of the slug without a trailing size, else by the longest alias
    that begins it and ends before a hyphen. The alias table is a few hundred rows, so it is one literal: no join."""
    known = F.from_json(F.lit(json.dumps(dict(T.alias_rows()))), "map<string,string>")
    s = X.slug(F.col(family))
    parts = F.split(s, "-")
    heads = F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))
    begun = F.get(F.filter(heads, lambda h: (F.length(h) >= 3) & known[h].isNotNull()), F.lit(0))
    return found.withColumn("kb_family", F.coalesce(known[s], known[F.regexp_replace(s, "-?[0-9]{2,5}$", "")], known[begun]))


#: Rows that a verdict may look at besides family, name, key_size and mode.
FACTS = {"padding": "string", "alg": "string", "groups": "string", "iterations": "int"}
ITERATIONS = 600_000
# Spellings of paddings that break a cipher.
BAD_PADDINGS = "pkcs1v15 pkcs1-v1-5 pkcs1v1-5 pkcs-1-v1-5 rsa-pkcs1-padding pkcs1padding nopadding no-padding raw-rsa textbook-rsa".split()


def threat(family: Column, base: Column, size: Column, mode: Column, inner: Column | None = None, facts: dict[str, Column] | None = None) -> Column:
    """The verdict of a resolved family with its parameters; an unresolved one is unknown. ``facts`` are the columns of
    ``FACTS`` but ``alg``: a handshake with a hybrid group is post-quantum, few iterations of PBKDF2 are weak, and a broken mode
    or padding (but RSA's own) outweighs a better verdict."""
    none = F.lit(None)
    padding, groups, iterations = ((facts or {}).get(k, none.cast(FACTS[k])) for k in ("padding", "groups", "iterations"))
    mode = F.upper(F.coalesce(mode, F.lit("")))
    inner = F.lower(F.coalesce(inner, F.lit(""))) if inner is not None else F.lit("")
    block = F.when(mode == "ECB", "legacy_broken").when(size.isNull(), "grover_weakened").when(size < 128, "legacy_broken").when(size < 256, "grover_weakened").when(mode == "CBC", "grover_weakened").otherwise("quantum_safe")
    digest = F.when(size < 224, "legacy_broken").when(size < 384, "grover_weakened").when(size.isNotNull(), "quantum_safe")
    mac = F.when(inner.startswith("md"), "legacy_broken").when(inner.rlike("^sha-?1$"), "grover_weakened").when(inner.rlike("^sha-?[23]") & (size < 256), "grover_weakened").otherwise("quantum_safe")
    hybrid = F.coalesce(groups, F.lit("")).rlike("(?i)ml[^a-z0-9]*kem|kyber")
    special = (
        F.when(family.isin("AES", "Camellia", "ARIA"), block)
        .when(family == "SHA-2", F.coalesce(digest, F.lit("unknown")))
        .when(family == "SHA-3", F.coalesce(digest, F.lit("quantum_safe")))
        .when(family == "SHAKE", F.when(size <= 128, "grover_weakened").otherwise("quantum_safe"))
        .when(family == "HMAC", mac)
        .when(family.isin("TLS1.2", "TLS1.3") & hybrid, "pqc")
        .when((family == "PBKDF2") & (iterations < ITERATIONS), "grover_weakened")
    )
    general = F.coalesce(special, base, F.lit("unknown"))
    bad = (mode == "ECB") | (F.lower(F.coalesce(padding, F.lit(""))).isin(BAD_PADDINGS) & ~family.isin("RSA", "RSASSA-PSS", "RSAES-OAEP"))
    escaped = general.isin("quantum_safe", "grover_weakened", "pqc") & ~family.isin("AES", "Camellia", "ARIA")
    return F.when(bad & escaped, "legacy_broken").otherwise(general)


def classified(found: DataFrame) -> DataFrame:
    """``found (family, name, key_size, mode, ...)`` with ``kb_family, category, threat``. The hash inside a keyed one is read from
    its name, as in HMAC-MD5 or HmacSHA1. Columns of ``FACTS`` are read where they are there. A token (JWT) has the verdict of the
    algorithm it names: ``none`` is broken, one that the table knows is judged as that, others and no name are unknown."""
    told = F.regexp_replace(F.lower("name"), "^hmac[-_ ]?", "") if "name" in found.columns else F.lit("")
    inner = F.col("inner_hash")  # a column below the join: verdicts name it many times
    facts = {k: F.col(k) for k in FACTS if k in found.columns and k != "alg"}
    known = T.families(found.sparkSession)
    r = resolved(found).withColumn("inner_hash", told).join(F.broadcast(known), "kb_family", "left")
    own = threat(F.col("kb_family"), F.col("base_threat"), F.col("key_size"), F.col("mode"), inner, facts)
    if "alg" not in found.columns:
        return r.withColumn("threat", own).drop("base_threat", "inner_hash")
    said = known.select(F.col("kb_family").alias("alg_family"), F.col("base_threat").alias("alg_base"))
    named = resolved(r.withColumnRenamed("kb_family", "own_family"), "alg").withColumnsRenamed({"kb_family": "alg_family", "own_family": "kb_family"})
    j = named.join(F.broadcast(said), "alg_family", "left")  # fixed tables
    judged = threat(F.col("alg_family"), F.col("alg_base"), F.col("key_size"), F.col("mode"), None, facts)
    token = F.when(X.slug(F.col("alg")) == "none", "legacy_broken").when(F.col("alg_family").isNotNull() & (F.col("alg_family") != "JWT"), judged).otherwise("unknown")
    return j.withColumn("threat", F.when(F.col("kb_family") == "JWT", token).otherwise(own)).drop("base_threat", "inner_hash", "alg_family", "alg_base")
