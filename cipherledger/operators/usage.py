"""What an asset is used for, signing or key establishment: from declared roles, from its kind, else from the source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of extras that declare a role, what roles hold, and words of free text (whole words only).
DECLARING = "usage usages role roles operation operations purpose key_usage keyusage crypto_function crypto_functions primitive alg algorithm_use ext_key_usage".split()
SIGN_ROLES = "sign verify signature certsign crlsign codesign jws jwt attest nonrepudiation rs256 rs384 rs512 ps256 ps384 ps512 es256 es384 pss".split()
KEX_ROLES = "encrypt decrypt keyagreement keyencipherment dataencipherment keytransport keyestablishment kem kex keyexchange wrap unwrap envelope seal unseal oaep rsaes".split()
SIGN_WORDS = "sign signs signed signer signing signature signatures verify verifies verifier verification jws jwt attest attestation codesign certsign crlsign nonrepudiation rs256 rs384 rs512 ps256 ps384 ps512 es256 es384 pss".split()
KEX_WORDS = "encrypt encrypts encrypted encryption decrypt decrypts decrypted decryption keyagreement keyencipherment dataencipherment keytransport keyestablishment kem kex keyexchange wrap wraps unwrap envelope seal seals unseal oaep rsaes".split()


def declares(said: Column, roles: list[str]) -> Column:
    """Whether a declared role, squeezed to letters and digits, holds one of ``roles``."""
    plain = F.regexp_replace(F.lower(F.coalesce(said, F.lit(""))), "[^a-z0-9]", "")
    return plain.rlike("|".join(roles))


def mentions(text: Column, words: list[str]) -> Column:
    """Whether free text has one of ``words`` as a whole word: design is no sign."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("(?<![a-z])(?:" + "|".join(words) + ")(?![a-z])")


def used(found: DataFrame, by: str = "asset_key") -> DataFrame:
    """``by, usage``: sign, kex or null (neither or both) of the assets of ``found (by, name, kind, evidence)`` and ``extra``, a map, if it has
    one. Declared roles win over everything, a certificate signs, and only else does the text of all its places count.
    Four flags an asset: a grouped sum however often it occurs."""
    if "extra" in found.columns:
        said = F.concat_ws(" ", *(F.col("extra")[k] for k in DECLARING))
        more = F.concat_ws(" ", F.map_values("extra"))
    else:
        said = more = F.lit("")
    text = F.concat_ws(" ", "name", "kind", "evidence", more)
    flags = {"said_sign": declares(said, SIGN_ROLES), "said_kex": declares(said, KEX_ROLES), "sign": mentions(text, SIGN_WORDS), "kex": mentions(text, KEX_WORDS), "certificate": F.lower("kind") == "certificate"}
    g = found.groupBy(by).agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()))
    declared = F.col("said_sign") | F.col("said_kex")
    sign = F.when(declared, F.col("said_sign")).otherwise(F.col("certificate") | F.col("sign"))
    kex = F.when(declared, F.col("said_kex")).otherwise(~F.col("certificate") & F.col("kex"))
    return g.select(by, F.when(sign & ~kex, "sign").when(kex & ~sign, "kex").alias("usage"))
