"""Operator 10 [native]. Secret scans with multipart credential linking: DataFrame and SQL functions only.

Base spans (the contract of ``op10``), leftmost non-overlapping per kind, offsets in code points, end exclusive:
``assign`` a keyword, ``:`` or ``=`` and a value of 6 or more characters; ``access`` an AKIA identifier of 20 or more;
``hex`` a run of 24 or more lowercase hexadecimal digits. They are always reported.

Parts that the method adds: ``weak`` an opaque word of 20 or more characters with a digit, an upper- and a lower-case
letter that meets no base span; ``ident`` a user, account or client identifier; ``endpoint`` a URL or host setting.
Secrets (assign, hex, weak) and their complements (access, ident, endpoint) are interval-joined within scopes: two parts
are in one scope if at most ``SCOPE`` characters lie between them. A weak word counts only with a complement in its
scope, an identifier or endpoint only with a secret in its scope. The join deals intervals to buckets of ``SCOPE``
characters of one text and only asks whether a partner exists (semi joins), so its rows stay linear in the parts and no
key is larger than one scope of one text.

Null text is an empty text, which has no spans. Rows with the same doc_id and text have the same spans; null doc_ids
are kept. Very long texts are scanned whole. Columns other than doc_id and text are not read, so none can clash, and
``redacted`` returns all of them as they are. An empty table gives no rows. Spans have their start before their end; ties go by the kinds in the order above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear_name, cut, table

KINDS = ["assign", "access", "hex", "weak", "ident", "endpoint"]
SCOPE = 240
_WORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter run of either kind fails whole, wherever it is begun, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
WEAK = "[A-Za-z0-9+/_-]{20,}={0,2}"
IDENT = r"""(?:client_?id|access_?key_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\s"'<>]*|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]+)?"""
CHUNK = 64
_EMPTY = "cast(array() as array<struct<start:int,ord:int,end:int>>)"


def _spans(text: Column, pattern: str, kind: str, keep=None, value: int = 0) -> Column:
    """array<struct<start int, ord int, end int>> of the matches of ``pattern``. The gaps between the matches and the
    matches themselves give the offsets; sums run over chunks, so the work is near linear in the number of matches."""
    group = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    sizes = F.transform(F.split(text, pattern, -1), F.length), F.transform(group(0), F.length)
    parts = F.transform(F.arrays_zip(*sizes, group(value)), lambda x: F.struct(x["0"].alias("g"), x["1"].alias("h"), x["2"].alias("v")))

    def located(p: Column) -> Column:
        both = lambda s, x: s + x["g"] + F.coalesce(x["h"], F.lit(0))
        count = F.ceil(F.size(p) / CHUNK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.aggregate(F.slice(p, c * CHUNK + 1, CHUNK), F.lit(0), both))
        heads = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.aggregate(F.slice(sums, F.lit(1), c), F.lit(0), lambda s, x: s + x))
        whole = F.transform(
            p,
            lambda x, i: F.struct(
                (F.element_at(heads, (F.floor(i / CHUNK) + 1).cast("int")) + F.aggregate(F.slice(p, (F.floor(i / CHUNK) * CHUNK + 1).cast("int"), i % CHUNK), F.lit(0), both) + x["g"]).alias("start"),
                x["h"].alias("h"),
                x["v"].alias("v"),
            ),
        )
        good = F.filter(whole, lambda x: x["h"].isNotNull() & (keep(x) if keep else F.lit(True)))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (x["start"] + x["h"]).alias("end")))

    # one matching pass decides for the most texts, which have none
    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(parts), located), 1)).otherwise(F.expr(_EMPTY))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, th, base, weak, ident, endpoint``: span arrays of each text; th is a hash of the text."""
    t = F.col("text")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = rows.select(
        "doc_id",
        "th",
        _spans(t, ASSIGN, "assign", lambda x: F.length(x["v"]) >= 6, 2).alias("assign"),
        _spans(t, ACCESS, "access").alias("access"),
        _spans(t, HEX, "hex").alias("hex"),
        _spans(t, WEAK, "weak", lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[a-z]") & x["v"].rlike("[A-Z]")).alias("weak"),
        _spans(t, f"(?i:{IDENT})", "ident").alias("ident"),
        _spans(t, f"(?i:{ENDPOINT})", "endpoint").alias("endpoint"),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    return found.select("doc_id", "th", base.alias("base"), "weak", "ident", "endpoint")


def _buckets(parts: DataFrame, scope: int, reach: int) -> DataFrame:
    """``parts`` once for each bucket of ``scope`` characters that the interval widened by ``reach`` overlaps."""
    n = lambda x: F.floor(x / scope).cast("int")
    return parts.withColumn("bucket", F.explode(F.sequence(n(F.greatest(F.col("start") - reach, F.lit(0))), n(F.col("end") + reach))))


def _near(side: DataFrame, others: DataFrame, scope: int, gap: int, how: str) -> DataFrame:
    """Rows of ``side`` with (left_semi) or without (left_anti) one of ``others`` at most ``gap`` characters away."""
    key = ["id", "none", "th"]
    o = _buckets(others, scope, gap).select(*(F.col(k).alias(f"o_{k}") for k in (*key, "bucket", "start", "end")))
    hit = _buckets(side, scope, 0).join(o, [F.col(k) == F.col(f"o_{k}") for k in (*key, "bucket")] + [F.col("o_start") < F.col("end") + gap, F.col("start") < F.col("o_end") + gap], "left_semi")
    hit = hit.drop("bucket").distinct()
    return hit if how == "left_semi" else side.join(hit.select(*key, "start", "ord"), [*key, "start", "ord"], "left_anti")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, th, added``: the weak, ident and endpoint spans of ``scanned`` rows that have a partner in their scope."""
    some = found.where((F.size("weak") + F.size("ident") + F.size("endpoint") > 0) & (F.size("weak") + F.size("base") > 0))
    spans = some.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.explode(F.concat("base", "weak", "ident", "endpoint")).alias("s"))
    parts = cut(spans.select("th", "s.*", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none")))
    of = lambda *kinds: parts.where(F.col("ord").isin([KINDS.index(k) for k in kinds]))
    apart = _near(of("weak"), of("assign", "access", "hex"), scope, 0, "left_anti")  # the others lie in reported spans
    weak = cut(_near(apart, of("access", "ident", "endpoint"), scope, scope + 1, "left_semi"))
    complements = _near(of("ident", "endpoint"), of("assign", "hex").unionByName(weak), scope, scope + 1, "left_semi")
    added = weak.unionByName(complements)
    return added.groupBy("id", "none", "th").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "end"))).alias("added")).select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "th", "added")


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["ord"]), s["start"], s["end"])), ",")


def _merged(found: DataFrame, scope: int) -> DataFrame:
    """``found`` with ``every``, its base and added spans."""
    a = linked(found, scope).select(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"), "added")
    rows = found.join(a, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("th") == F.col("a_th")), "left")
    return rows.withColumn("added", F.coalesce("added", F.expr(_EMPTY))).withColumn("every", F.array_sort(F.concat("base", "added")))


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` for every row of ``docs``."""
    rows = _merged(cut(scanned(docs, doc_id, text)), scope)
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return rows.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("every")).alias("spans"),
        F.size("added").cast("bigint").alias("n_linked"),
    )


def op10_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every whole document."""
    return secrets(table(spark, sf_dir, "documents"))


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[REDACTED]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span of base secrets and weak words replaced by ``mark``; identifiers and endpoints stay.
    A row without secrets stays as it is. ``n_chars``, if there, is counted anew for changed texts."""
    found = cut(scanned(docs, doc_id, text))
    bad = F.filter("every", lambda s: s["ord"] <= KINDS.index("weak"))
    # overlapping spans become one: (start, end), in order
    last = lambda acc: F.element_at(acc, -1)
    join = F.aggregate(
        bad,
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    own = {c: clear_name(docs, f"redact_{c}") for c in ("id", "th", "cuts")}
    cuts = _merged(found, scope).where(F.size(bad) > 0).dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias(own["id"]), F.col("th").alias(own["th"]), join.alias(own["cuts"]))
    c = F.col(own["cuts"])
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(c, i - 1)["end"])
    kept = F.transform(c, lambda s, i: F.col(text).substr(before(i) + 1, s["start"] - before(i)))
    rest = F.col(text).substr(F.element_at(c, -1)["end"] + 1, F.length(text))
    out = docs.join(cuts, docs[doc_id].cast("bigint").eqNullSafe(cuts[own["id"]]) & (F.xxhash64(docs[text]) == cuts[own["th"]]), "left")
    new = F.when(c.isNull(), F.col(text)).otherwise(F.concat(F.array_join(kept, mark), F.lit(mark), rest))
    size = {n: F.when(c.isNull(), F.col(n)).otherwise(F.length(new)) for n in docs.columns if n == "n_chars"}
    return out.select(*((size.get(n) if n in size else new if n == text else docs[n]).alias(n) for n in docs.columns))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are cut out of the texts; every document stays, null and empty texts as they are, repeated rows alike; other
    columns are kept but for ``n_chars`` of changed texts. An empty table stays empty."""
    return redacted(docs)


def _oracle() -> str:
    """The same scan for DuckDB: offsets from the pieces between matches, linking by correlated intervals."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    patterns = [ASSIGN, ACCESS, HEX, WEAK, f"(?i:{IDENT})", f"(?i:{ENDPOINT})"]
    kinds = ", ".join(f"({i}, {q(k)}, {q(r)})" for i, (k, r) in enumerate(zip(KINDS, patterns)))
    near = f"o.s < w.e + {SCOPE + 1} AND w.s < o.e + {SCOPE + 1}"
    parts = ", ".join(
        f"m{i} AS (SELECT doc_id, {i} AS ord, string_split_regex(t, {q(r)}) AS g, regexp_extract_all(t, {q(r)}) AS h, regexp_extract_all(t, {q(r)}, {2 if i == 0 else 0}) AS v FROM d)" for i, r in enumerate(patterns)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), kinds(ord, kind, rx) AS (VALUES {kinds}),
{parts}, m AS ({" UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(patterns)))}),
u AS (SELECT doc_id, ord, g, h, v, unnest(range(1, len(h) + 1)) AS i FROM m WHERE len(h) > 0),
x AS (SELECT doc_id, ord, v[i] AS v, length(h[i]) AS n, coalesce(list_sum([length(y) for y in g[1:i]]), 0) + coalesce(list_sum([length(y) for y in h[1:i - 1]]), 0) AS s FROM u),
p AS (SELECT doc_id, ord, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM x WHERE CASE ord WHEN 0 THEN length(v) >= 6 WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') ELSE true END),
weak AS (SELECT * FROM p w WHERE ord = 3
  AND NOT EXISTS (SELECT 1 FROM p o WHERE o.doc_id = w.doc_id AND o.ord < 3 AND o.s < w.e AND w.s < o.e)
  AND EXISTS (SELECT 1 FROM p o WHERE o.doc_id = w.doc_id AND o.ord IN (1, 4, 5) AND {near})),
strong AS (SELECT * FROM p WHERE ord IN (0, 2) UNION ALL SELECT * FROM weak),
added AS (SELECT * FROM weak UNION ALL SELECT * FROM p w WHERE ord > 3 AND EXISTS (SELECT 1 FROM strong o WHERE o.doc_id = w.doc_id AND {near})),
every AS (SELECT doc_id, ord, s, e FROM p WHERE ord < 3 UNION ALL SELECT doc_id, ord, s, e FROM added),
listed AS (SELECT doc_id, string_agg(CASE WHEN every.ord < 3 THEN concat(kind, ':', s, ':', e) END, ',' ORDER BY s, every.ord) AS base, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, every.ord) AS spans,
  count(*) FILTER (every.ord = 0) AS n_assign, count(*) FILTER (every.ord = 1) AS n_access, count(*) FILTER (every.ord = 2) AS n_hex, count(*) FILTER (every.ord > 2) AS n_linked FROM every JOIN kinds ON kinds.ord = every.ord GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN listed ON listed.doc_id = d.doc_id
"""


ORACLE = _oracle()
