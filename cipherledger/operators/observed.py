"""Recorded TLS observations to findings: protocol, key exchange, bulk cipher, MAC and certificate of an endpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def target(c: Column) -> dict[str, Column]:
    """Host and port of ``host``, ``host:port``, ``[v6]:port`` or a URL; 443 where none is given."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "^[a-z]+://", ""), "[/?#].*$", "")
    v6 = F.regexp_extract(bare, r"^\[([^\]]+)\]", 1)
    plain = F.regexp_extract(bare, r"^([^:\[\]]+)(?::[0-9]+)?$", 1)
    host = F.when(v6 != "", v6).when(plain != "", plain).when(bare.rlike("^[0-9a-fA-F:]+$"), bare)
    port = F.when(bare.rlike(r"^\[") | (plain != ""), F.regexp_extract(bare, r":([0-9]+)$", 1))
    return {"host": F.lower(host), "port": F.coalesce(F.when(port != "", port.cast("int")), F.lit(443))}


def hostname_matches(pattern: Column, host: Column) -> Column:
    """Whether a certificate name covers a host: one wildcard, as the whole first label, over one label."""
    p, h = F.lower(pattern), F.lower(host)
    rest = F.regexp_extract(h, r"^[^.]+\.(.+)$", 1)
    return F.when(p.startswith("*."), (F.substring(p, 3, 1000) == rest) & (rest != "") & rest.contains(".")).otherwise(p == h)


def findings(seen: DataFrame) -> DataFrame:
    """``seen (endpoint, version, suite, group)`` as findings at ``tls://host:port``; a hybrid group is post-quantum."""
    t, s = target(F.col("endpoint")), N.suite(F.col("suite"))
    pq = F.lower(F.coalesce("group", F.lit(""))).rlike("mlkem|kyber")
    version = F.when(N.tls_version(F.col("version")).isNotNull(), F.regexp_replace(N.tls_version(F.col("version")), "^TLSv", "TLS"))
    text = lambda c: c.cast("string")
    row = lambda family, kind, size=F.lit(None), mode=F.lit(None): F.struct(family.alias("family"), F.lit(kind).alias("kind"), size.cast("int").alias("key_size"), text(mode).alias("mode"))
    mac = F.when(s["mac"].rlike("SHA-(?:256|384)"), "SHA-2").otherwise(s["mac"])
    mac_size = F.when(s["mac"].rlike("SHA-(?:256|384)"), F.substring(s["mac"], 5, 3))
    kex = F.when(pq, "ML-KEM").otherwise(F.regexp_replace(s["kex"], "E$", ""))
    rows = F.array(row(version, "protocol"), row(kex, "key agreement"), row(s["bulk"], "algorithm", s["bits"], F.when(s["mode"] != "Poly1305", s["mode"])), row(mac, "algorithm", mac_size))
    place = F.concat(F.lit("tls://"), t["host"], F.lit(":"), text(t["port"]))
    return seen.select(place.alias("file"), F.explode(rows).alias("r"), F.concat_ws(" ", "version", "suite", "group").alias("evidence")).where("r.family is not null").select("file", F.lit(0).alias("line"), "evidence", F.lit("tls").alias("detector"), F.lit("high").alias("confidence"), "r.*", F.col("r.family").alias("name"))
