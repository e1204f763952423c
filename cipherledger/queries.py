"""The registered queries of the inventory, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as T
from .functions import names as N
from .functions import risk_math as M
from .functions import text as X
from .operators import classify, emit, flat, gate, history, merge, policy, risk
from .plans import inventory
from .sources import corpus

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- shared SQL ---------------------------------------------------------------------------------------------------

_q = lambda s: "'" + s.replace("'", "''") + "'"
FOUND = "found AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in corpus.FINDINGS.items()) + " FROM lineitem)"
FILES = "files AS (SELECT concat(source, '/', lang, '/', doc_id, '.txt') AS path, text FROM documents UNION ALL SELECT concat('pages/', page_id, '.html'), html FROM pages UNION ALL SELECT concat('conv/', conv_id, '/', turn, '.txt'), text FROM conversations)"
LINES = FILES + ", parts AS (SELECT path, string_split(text, chr(10)) AS p FROM files), lines AS (SELECT path, i AS line, p[i] AS text FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM parts))"
RULES = "rules(rule, pattern, algorithm, tier, recommendation) AS (VALUES " + ", ".join(f"({_q(r)}, {_q(p)}, {_q(a)}, {_q(t)}, {_q(c)})" for r, p, a, t, c in T.FLAT_RULES) + ")"
FLAT = (
    LINES
    + ", "
    + RULES
    + r""", flat AS (SELECT path, CAST(line AS INTEGER) AS line, rule, algorithm, tier, recommendation,
  CASE WHEN regexp_matches(text, '^\s*(?:#|//|\*|/\*)') THEN 'low' WHEN regexp_matches(text, '[.(\[]|import |require\(|new [A-Z]|=\s*\w') THEN 'high' ELSE 'low' END AS confidence
  FROM lines, rules WHERE regexp_matches(lower(text), pattern)),
judged AS (SELECT *, CASE WHEN regexp_matches(lower(path), 'auth|identity|session|key|secret|login|token') THEN 25 WHEN regexp_matches(lower(path), 'payment|bank|pii|user') THEN 10 ELSE 5 END AS mosca_x FROM flat),
urgent AS (SELECT *, mosca_x + 3 > 10 AND tier IN ('BROKEN_Q', 'WEAK') AND confidence = 'high' AS urgent FROM judged),
mentions AS (SELECT DISTINCT path, line, algorithm, tier, urgent FROM urgent)"""
)


def _case(path: str, rules: list, default) -> str:
    lit = lambda v: _q(v) if isinstance(v, str) else repr(v)
    out = "CASE"
    for glob, v in reversed(rules):
        out += f" WHEN regexp_matches({path}, {_q(X.glob_regex(glob))}) THEN {lit(v)}"
    return out + f" ELSE {lit(default)} END"


_map = lambda c, table, default: "CASE " + c + "".join(f" WHEN {_q(k)} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"
PLACES = (
    FOUND
    + ", ranked AS (SELECT family, key_size, mode, file, line, confidence, detector, CASE confidence WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END AS c FROM found WHERE file NOT LIKE 'node_modules/%'), places AS (SELECT family, key_size, mode, file, line, confidence, detector, c FROM (SELECT *, row_number() OVER (PARTITION BY family, key_size, mode, file, line ORDER BY c DESC, detector, confidence) AS r FROM ranked) WHERE r = 1)"
    + f", placed0 AS (SELECT *, {_case('file', T.CLASS_RULES, 'default')} AS data_class, CAST({_case('file', T.CRITICALITY_RULES, 0.3)} AS DOUBLE) AS weight FROM places), placed AS (SELECT *, CAST({_map('data_class', T.CLASS_YEARS, 10)} AS INTEGER) AS x_years FROM placed0)"
)
THREATS = {"RSA": "shor_broken", "ECDSA": "shor_broken", "MD5": "legacy_broken", "3DES": "legacy_broken", "SHA-1": "legacy_broken", "ML-KEM": "pqc"}
ASSETS = (
    PLACES
    + """, g AS (SELECT family, key_size, mode, count(*) AS n_occ, count(DISTINCT file) AS n_files, max(c) AS best FROM placed GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, key_size, mode ORDER BY x_years DESC, weight DESC, file, line) AS r FROM placed) WHERE r = 1),
kept AS (SELECT g.*, w.file, w.line, w.data_class, w.x_years, w.weight FROM g JOIN w ON g.family = w.family AND g.key_size IS NOT DISTINCT FROM w.key_size AND g.mode IS NOT DISTINCT FROM w.mode
  WHERE best > 1 OR g.family NOT IN (SELECT family FROM g WHERE best = 3)),
t AS (SELECT *, CASE WHEN family IN ('RSA', 'ECDSA') THEN 'shor_broken' WHEN family IN ('MD5', '3DES', 'SHA-1') THEN 'legacy_broken' WHEN family = 'ML-KEM' THEN 'pqc'
  WHEN family = 'AES' THEN CASE WHEN mode = 'ECB' THEN 'legacy_broken' WHEN key_size IS NULL OR key_size < 256 THEN 'grover_weakened' WHEN mode = 'CBC' THEN 'grover_weakened' ELSE 'quantum_safe' END
  WHEN family = 'SHA-2' THEN CASE WHEN key_size < 384 THEN 'grover_weakened' ELSE 'quantum_safe' END END AS threat,
  concat(family, '|', coalesce(CAST(key_size AS VARCHAR), 'None'), '|None|', coalesce(mode, 'None'), '|', family, '|algorithm') AS asset_key,
  CASE WHEN family IN ('AES', 'SHA-2') THEN 1 ELSE 3 END AS y_years FROM kept),
m AS (SELECT *, CAST(x_years + y_years - (2035 - 2026) AS INTEGER) AS shortfall, threat IN ('shor_broken', 'legacy_broken') AND x_years + y_years - 9 > 0 AS act_now FROM t),
s AS (SELECT *, CASE WHEN threat IN ('shor_broken', 'legacy_broken') THEN CASE WHEN act_now THEN 'critical' ELSE 'high' END WHEN threat = 'grover_weakened' THEN 'low' ELSE 'none' END AS severity,
  CASE WHEN abs(weight - 1.0) <= abs(weight - 0.8) THEN 1.0 WHEN round(abs(weight - 0.8), 9) <= round(abs(weight - 0.55), 9) THEN 0.8 WHEN round(abs(weight - 0.55), 9) <= round(abs(weight - 0.3), 9) THEN 0.55 WHEN round(abs(weight - 0.3), 9) <= round(abs(weight - 0.15), 9) THEN 0.3 ELSE 0.15 END AS cw FROM m),
s2 AS (SELECT *, CAST(round(100 * CASE threat WHEN 'shor_broken' THEN 1.0 WHEN 'legacy_broken' THEN 0.95 WHEN 'grover_weakened' THEN 0.5 WHEN 'quantum_safe' THEN 0.05 WHEN 'pqc' THEN 0.0 ELSE 0.25 END
    * (0.7 + 0.3 * CASE WHEN act_now THEN least(1.0, CAST(shortfall AS DOUBLE) / greatest(1, x_years + y_years)) ELSE 0.0 END) * cw, 2) AS DOUBLE) AS raw FROM s),
assets AS (SELECT *, CASE WHEN severity = 'none' THEN least(raw, 5.0) ELSE raw END AS score, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS severity_rank,
  CASE WHEN threat IN ('shor_broken', 'legacy_broken') THEN CAST(2035 - x_years - y_years AS INTEGER) END AS deadline_year FROM s2)"""
)


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.assets(corpus.findings(spark, sf_dir))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.places(corpus.findings(spark, sf_dir))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.judged(flat.findings(corpus.lines(flat.mentioning(corpus.text_files(spark, sf_dir)))))


# --- flat scanner ----------------------------------------------------------------------------------------------------


@query(f"WITH {FLAT} SELECT path, line, rule, algorithm, tier, confidence, mosca_x, urgent FROM urgent")
def flat_findings(spark, sf_dir):
    return _flat(spark, sf_dir).select("path", "line", "rule", "algorithm", "tier", "confidence", "mosca_x", "urgent")


@query(f"WITH {FLAT} SELECT algorithm, tier, count(*) AS n, count(*) FILTER (urgent) AS n_urgent, count(DISTINCT path) AS n_files FROM mentions GROUP BY algorithm, tier")
def flat_tier_counts(spark, sf_dir):
    return flat.tier_counts(_flat(spark, sf_dir))


@query(f"WITH {FLAT} SELECT path, line, algorithm, tier, urgent FROM mentions ORDER BY list_position(['BROKEN_Q', 'WEAK', 'SAFE', 'PQC'], tier), urgent DESC, path, line, algorithm LIMIT 80")
def flat_top80(spark, sf_dir):
    return flat.top(_flat(spark, sf_dir)).select("path", "line", "algorithm", "tier", "urgent")


@query(f"WITH {FLAT} SELECT DISTINCT algorithm, tier, recommendation FROM urgent WHERE confidence <> 'low'")
def flat_components(spark, sf_dir):
    return flat.components(_flat(spark, sf_dir))


# --- merging ----------------------------------------------------------------------------------------------------------


@query(f"WITH {PLACES} SELECT family, key_size, mode, file, line, confidence, detector FROM places")
def merge_occurrences(spark, sf_dir):
    return inventory.places(corpus.findings(spark, sf_dir)).select("family", "key_size", "mode", "file", "line", "confidence", "detector")


@query(f"WITH {PLACES} SELECT family, key_size, mode, count(*) AS n_occ, count(DISTINCT file) AS n_files, max(c) AS best_confidence FROM placed GROUP BY ALL")
def merge_assets(spark, sf_dir):
    return merge.assets(inventory.places(corpus.findings(spark, sf_dir)), ["family", "key_size", "mode"])


@query(f"WITH {FOUND}, g AS (SELECT family, detector, line, max(CASE confidence WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END) AS best_confidence FROM found WHERE detector = 'F' AND line > 5 GROUP BY ALL) SELECT * FROM g WHERE best_confidence <> 1 OR family NOT IN (SELECT family FROM g WHERE best_confidence = 3)")
def merge_noise(spark, sf_dir):
    g = corpus.findings(spark, sf_dir).where("detector = 'F' and line > 5").groupBy("family", "detector", "line").agg(F.max(merge.confidence_rank(F.col("confidence"))).alias("best_confidence"))
    return merge.without_noise(g)


@query()
def merge_wildcard(spark, sf_dir):
    a = _assets(spark, sf_dir).withColumnRenamed("asset_key", "asset_id")
    return merge.wildcard_merged(a)


@query(f"WITH {FOUND} SELECT family, mode, max(key_size) AS key_size, count(*) AS n_merged FROM (SELECT family, mode, key_size, file, line FROM found WHERE line = 7) GROUP BY ALL")
def merge_filled(spark, sf_dir):
    f = corpus.findings(spark, sf_dir).where("line = 7")
    rich = F.coalesce(F.col("key_size"), F.lit(0))
    return merge.first_filled(f, ["family", "mode"], ["key_size"], rich, F.concat_ws("/", "file", "confidence")).withColumn("n_merged", F.col("n_merged").cast("long"))


# --- classification, policy, risk --------------------------------------------------------------------------------------


@query(f"WITH {ASSETS} SELECT family, key_size, mode, threat FROM assets")
def kb_classify(spark, sf_dir):
    return _assets(spark, sf_dir).select("family", "key_size", "mode", "threat")


#: Spellings and the family that each means, written down by hand; a table's rows pick one each, with noise around it.
SPELLED = [
    ("Triple DES", "3DES"), ("org/lib/SHA_256", "SHA-2"), ("rsa2048", "RSA"), ("aes-128-cbc", "AES"), ("X25519", "X25519"), ("kyber768", "ML-KEM"), ("tls v9", None), ("RSA 4096", "RSA"), ("des-ede3", "3DES"), ("hmac sha256", "HMAC"),
    ("Dilithium", "ML-DSA"), ("curve25519", "X25519"), ("TLSv1", "TLS1.0"), ("sha_1", "SHA-1"), ("ES256", "ECDSA"), ("rot13", None),
]


def _picked(key: str, values: list) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else _q(v) if isinstance(v, str) else v}" for i, v in enumerate(values)) + " END"


_SPELLING = f"concat({_picked('o_custkey', ['', '  ', 'a/b/'])}, {_picked('o_orderkey', [x for x, _ in SPELLED])}, {_picked('o_custkey', ['', ' '])})"


@query(f"SELECT o_orderkey, {_SPELLING} AS spelling, {_picked('o_orderkey', [f for _, f in SPELLED])} AS kb_family FROM orders")
def kb_resolve(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_SPELLING} AS spelling")
    return classify.resolved(o, "spelling").select("o_orderkey", "spelling", "kb_family")


@query(r"SELECT DISTINCT p_type, trim(regexp_replace(regexp_replace(list_extract(string_split(lower(trim(p_type)), '/'), -1), '[\s_.:]+', '-', 'g'), '-+', '-', 'g'), '-') AS slug, regexp_replace(upper(p_type), '[^A-Z0-9]', '', 'g') AS squashed, left(sha256(concat(p_type, chr(9247), p_brand)), 16) AS id FROM part")
def text_slugs(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    return p.select("p_type", X.slug(F.col("p_type")).alias("slug"), X.squash(F.col("p_type")).alias("squashed"), X.stable_id(F.col("p_type"), F.col("p_brand")).alias("id"))


@query(f"WITH {PLACES} SELECT file, line, data_class, x_years, weight FROM placed GROUP BY ALL")
def policy_paths(spark, sf_dir):
    return policy.placed(inventory.places(corpus.findings(spark, sf_dir))).select("file", "line", "data_class", "x_years", "weight").distinct()


@query(f"WITH {ASSETS} SELECT family, key_size, mode, file, line, data_class, x_years, weight FROM assets")
def policy_worst_place(spark, sf_dir):
    return _assets(spark, sf_dir).select("family", "key_size", "mode", "file", "line", "data_class", "x_years", "weight")


@query(
    "WITH i AS (SELECT DISTINCT l_linenumber * 6 - 6 AS x, CAST(l_quantity AS INTEGER) % 7 AS y, 2030 + l_linenumber AS z FROM lineitem) "
    "SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, CAST(greatest(x, 0) + greatest(y, 0) - (z - 2026) AS INTEGER) AS shortfall, greatest(x, 0) + greatest(y, 0) - (z - 2026) > 0 AS act_now, CAST(z - x - y AS INTEGER) AS deadline FROM i"
)
def mosca_math(spark, sf_dir):
    i = corpus.table(spark, sf_dir, "lineitem").selectExpr("cast(l_linenumber * 6 - 6 as int) x", "cast(l_quantity as int) % 7 y", "cast(2030 + l_linenumber as int) z").distinct()
    x, y, z = (F.col(c) for c in "xyz")
    s = M.shortfall(x, y, z, 2026)
    return i.select("x", "y", "z", s.alias("shortfall"), M.act_now(s).alias("act_now"), M.deadline(x, y, z).alias("deadline"))


RISK_COLUMNS = "asset_key, family, key_size, mode, n_occ, n_files, threat, x_years, y_years, shortfall, act_now, deadline_year, severity, score, severity_rank"


@query(f"WITH {ASSETS} SELECT {RISK_COLUMNS} FROM assets")
def risk_assets(spark, sf_dir):
    return _assets(spark, sf_dir).select(*RISK_COLUMNS.split(", "))


@query(f"WITH {ASSETS} SELECT asset_key, CAST(row_number() OVER (ORDER BY severity_rank DESC, score DESC, n_occ DESC, lower(family), asset_key) AS INTEGER) AS rank FROM assets")
def risk_ranked(spark, sf_dir):
    return risk.ranked(_assets(spark, sf_dir)).select("asset_key", "rank")


@query(
    f"WITH {ASSETS} SELECT count(*) AS n_assets, count(*) FILTER (threat = 'shor_broken') AS n_shor_broken, count(*) FILTER (threat = 'legacy_broken') AS n_legacy_broken, count(*) FILTER (threat = 'grover_weakened') AS n_grover_weakened, count(*) FILTER (threat = 'quantum_safe') AS n_quantum_safe, count(*) FILTER (threat = 'pqc') AS n_pqc, count(*) FILTER (threat = 'unknown') AS n_unknown, count(*) FILTER (threat IN ('shor_broken', 'legacy_broken', 'grover_weakened')) AS n_vulnerable, count(*) FILTER (act_now) AS n_act_now, max(score) AS max_score, round(avg(score), 4) AS mean_score, CAST(sum(n_occ) AS BIGINT) AS n_occurrences FROM assets"
)
def risk_summary(spark, sf_dir):
    return risk.summary(_assets(spark, sf_dir))


@query(f"WITH {ASSETS}, d(severity, severity_rank) AS (VALUES ('critical', 4), ('high', 3), ('medium', 2), ('low', 1), ('none', 0)) SELECT d.severity, CAST(d.severity_rank AS BIGINT) AS severity_rank, count(a.severity) AS n FROM d LEFT JOIN assets a ON a.severity = d.severity GROUP BY ALL")
def risk_severity_counts(spark, sf_dir):
    return risk.severity_counts(_assets(spark, sf_dir)).withColumn("severity_rank", F.col("severity_rank").cast("long"))


# --- recommendations ------------------------------------------------------------------------------------------------------

_RULE = """CASE WHEN threat = 'pqc' THEN 'PQC_OK' WHEN family = 'ECDSA' THEN CASE WHEN x_years >= 20 THEN 'SIG_SLHDSA' ELSE 'SIG_MLDSA' END WHEN family = 'RSA' THEN 'AMBIGUOUS_USAGE'
 WHEN family IN ('MD5', 'SHA-1') THEN 'HASH_SHA256' WHEN mode = 'ECB' THEN 'ECB_TO_GCM' WHEN family = '3DES' THEN 'CIPHER_AES256' WHEN family = 'AES' AND coalesce(key_size, 0) < 256 THEN 'AES128_UPGRADE'
 WHEN mode = 'CBC' THEN 'UNAUTH_MODE_TO_AEAD' WHEN family = 'SHA-2' AND key_size < 384 THEN 'SHA256_TO_384' WHEN threat = 'quantum_safe' THEN 'QSAFE_OK' ELSE 'UNKNOWN' END"""
_ADVICE = "advice(rule_id, recommendation, standard) AS (VALUES " + ", ".join(f"({_q(k)}, {_q(a)}, {_q(b)})" for k, (a, b) in T.ADVICE.items()) + ")"


@query(f"WITH {ASSETS}, {_ADVICE}, r AS (SELECT *, {_RULE} AS rule_id FROM assets) SELECT asset_key, r.rule_id, recommendation, standard, concat(family, ' seen ', n_occ, ' times in ', n_files, ' files, first at ', file, ':', line) AS rationale FROM r LEFT JOIN advice USING (rule_id)")
def recommend_assets(spark, sf_dir):
    return _assets(spark, sf_dir).select("asset_key", "rule_id", "recommendation", "standard", "rationale")


# --- gate -------------------------------------------------------------------------------------------------------------------

IGNORE = ["docs", "**/tests/**"]
WAIVERS = [
    (1, "MD5", None, None, "vendor fix pending", "2027-01-01"),
    (2, "RSA", "critical", None, "old approval", "2024-01-01"),  # the severity is no field
    (3, None, None, "^payments/", "", "2027-01-01"),
    (4, None, None, None, "matches nothing", "2027-01-01"),
    (5, "SHA-1", None, None, "no date", None),
    (6, "AES", None, "/", "every place of it has a folder", "2027-01-01"),
    (7, None, "high", None, "a severity alone matches nothing", "2027-01-01"),
]
TODAY = "2026-06-01"


def _gated(spark, sf_dir):
    w = spark.createDataFrame(WAIVERS, "ord int, family string, severity_is string, file_regex string, reason string, expires string")
    at = _places(spark, sf_dir).select("asset_key", "file")
    return gate.waived(gate.flagged(_assets(spark, sf_dir), "high", "low", True, IGNORE, at), w, TODAY, at)


_IGN = " OR ".join(f"regexp_matches(file, {_q(X.glob_regex(p))})" for g in IGNORE for p in (g, g.rstrip("/") + "/**"))
GATED = (
    ASSETS
    + ", spots AS (SELECT DISTINCT concat(family, '|', coalesce(CAST(key_size AS VARCHAR), 'None'), '|None|', coalesce(mode, 'None'), '|', family, '|algorithm') AS asset_key, file FROM places)"
    + f", f AS (SELECT *, NOT EXISTS (SELECT 1 FROM spots WHERE spots.asset_key = assets.asset_key AND NOT ({_IGN.replace('(file,', '(spots.file,')})) AS ignored FROM assets), f2 AS (SELECT *, NOT ignored AND severity_rank < 1 AND NOT act_now AS below FROM f), flagged AS (SELECT *, NOT ignored AND NOT below AND (severity_rank >= 3 OR act_now) AS blocking FROM f2)"
    + ", waivers(ord, w_family, severity_is, file_regex, reason, expires) AS (VALUES "
    + ", ".join("(" + ", ".join("NULL" if v is None else _q(v) if isinstance(v, str) else str(v) for v in w) + ")" for w in WAIVERS)
    + f"), wd AS (SELECT *, coalesce(try_cast(expires AS DATE) < DATE '{TODAY}', true) OR trim(reason) = '' AS dead FROM waivers WHERE w_family IS NOT NULL OR file_regex IS NOT NULL)"
    + ", hits AS (SELECT asset_key, ord, dead, row_number() OVER (PARTITION BY asset_key ORDER BY dead, ord) AS r FROM flagged, wd WHERE (w_family IS NULL OR lower(family) = lower(w_family)) AND (file_regex IS NULL OR (SELECT bool_and(regexp_matches(spots.file, file_regex)) FROM spots WHERE spots.asset_key = flagged.asset_key)))"
    + ", gated AS (SELECT flagged.*, h.ord AS waiver_ord, h.dead AS waiver_expired FROM flagged LEFT JOIN (SELECT * FROM hits WHERE r = 1) h USING (asset_key))"
)


@query(f"WITH {GATED} SELECT asset_key, ignored, below, blocking, CAST(waiver_ord AS INTEGER) AS waiver_ord, waiver_expired FROM gated")
def gate_flags(spark, sf_dir):
    return _gated(spark, sf_dir).select("asset_key", "ignored", "below", "blocking", "waiver_ord", "waiver_expired")


@query(f"WITH {GATED}, v AS (SELECT count(*) AS n_assets, count(*) FILTER (ignored) AS n_ignored, count(*) FILTER (below) AS n_below, count(*) FILTER (blocking AND coalesce(waiver_expired, true)) AS n_blocking, count(*) FILTER (blocking AND coalesce(NOT waiver_expired, false)) AS n_waived, count(*) FILTER (blocking AND coalesce(waiver_expired, false)) AS n_expired, CAST((count(*) FILTER (NOT ignored AND NOT below AND severity = 'critical') > 3)::INTEGER + (count(*) FILTER (NOT ignored AND NOT below AND severity = 'low') > 50)::INTEGER AS BIGINT) AS n_over_budget FROM gated) SELECT *, CAST(n_blocking > 0 OR n_over_budget > 0 AS INTEGER) AS exit_code FROM v")
def gate_verdict(spark, sf_dir):
    return gate.verdict(_gated(spark, sf_dir), {"critical": 3, "low": 50})


@query(f"WITH {GATED} SELECT asset_key, severity, score FROM gated WHERE blocking AND coalesce(waiver_expired, true) ORDER BY severity_rank DESC, score DESC, family, asset_key LIMIT 10")
def gate_offenders(spark, sf_dir):
    return gate.offenders(_gated(spark, sf_dir)).select("asset_key", "severity", "score")


# --- history -----------------------------------------------------------------------------------------------------------------


def _history(spark, sf_dir):
    """A scan a year: every year's findings merged and judged on their own."""
    f = corpus.findings(spark, sf_dir)
    p = policy.placed(merge.occurrences(inventory.completed(f), ["scan_id", *inventory.KEYS]).withColumn("asset_key", merge.key(F.col("family"), F.col("key_size"), F.col("curve"), F.col("mode"))))
    w = policy.worst(p, ["scan_id", "asset_key", "family", "key_size", "mode"])
    return risk.scored(classify.classified(w))


HISTORY = (
    FOUND
    + f", o AS (SELECT DISTINCT scan_id, family, key_size, mode, file, line FROM found), o2 AS (SELECT *, {_case('file', T.CLASS_RULES, 'default')} AS data_class FROM o), o3 AS (SELECT *, CAST({_map('data_class', T.CLASS_YEARS, 10)} AS INTEGER) AS x_years FROM o2)"
    + ", h0 AS (SELECT scan_id, family, key_size, mode, concat(family, '|', coalesce(CAST(key_size AS VARCHAR), 'None'), '|None|', coalesce(mode, 'None')) AS asset_key, max(x_years) AS x, count(*) AS n_occ FROM o3 GROUP BY ALL)"
    + ", h1 AS (SELECT *, CASE WHEN family IN ('RSA', 'ECDSA', 'MD5', '3DES', 'SHA-1') OR mode = 'ECB' THEN 1 ELSE 0 END AS broken, CASE WHEN family IN ('AES', 'SHA-2') THEN 1 ELSE 3 END AS y FROM h0)"
    + ", hist AS (SELECT *, CASE WHEN broken = 1 THEN CASE WHEN x + y > 9 THEN 4 ELSE 3 END WHEN family = 'ML-KEM' THEN 0 WHEN family = 'AES' AND key_size = 256 AND coalesce(mode, '') <> 'CBC' THEN 0 WHEN family = 'SHA-2' AND key_size = 384 THEN 0 ELSE 1 END AS rank, broken = 1 AND x + y > 9 AS act_now FROM h1)"
)


@query(f"WITH {HISTORY} SELECT scan_id, count(*) AS n_assets, count(*) FILTER (rank = 4) AS n_critical, count(*) FILTER (rank = 3) AS n_high, count(*) FILTER (rank = 2) AS n_medium, count(*) FILTER (rank = 1) AS n_low, count(*) FILTER (rank = 0) AS n_none, CAST(sum(n_occ) AS BIGINT) AS n_occurrences, count(*) FILTER (act_now) AS n_act_now, CAST(sum(rank) AS BIGINT) AS weighted_risk FROM hist GROUP BY scan_id")
def history_scans(spark, sf_dir):
    return history.scans(_history(spark, sf_dir))


@query(f"WITH {FOUND} SELECT DISTINCT scan_id FROM found ORDER BY scan_id DESC LIMIT 2")
def history_latest(spark, sf_dir):
    return history.latest(corpus.findings(spark, sf_dir))


@query(f"WITH {HISTORY}, a AS (SELECT * FROM hist WHERE scan_id = 1996), b AS (SELECT * FROM hist WHERE scan_id = 1997) SELECT coalesce(a.asset_key, b.asset_key) AS asset_key, CASE WHEN a.rank IS NULL THEN 'added' WHEN b.rank IS NULL THEN 'removed' WHEN a.n_occ <> b.n_occ OR a.rank <> b.rank THEN 'changed' ELSE 'unchanged' END AS status, CAST(a.rank AS INTEGER) AS rank_a, CAST(b.rank AS INTEGER) AS rank_b FROM a FULL OUTER JOIN b ON a.asset_key = b.asset_key")
def history_diff(spark, sf_dir):
    h = _history(spark, sf_dir).drop("score")
    return history.diff(h, 1996, 1997).select("asset_key", "status", "rank_a", "rank_b")


@query(f"WITH {HISTORY}, s AS (SELECT scan_id, sum(rank) AS r, count(*) FILTER (act_now) AS n, count(*) AS t FROM hist GROUP BY scan_id), p AS (SELECT CAST(max(CASE WHEN scan_id = 1996 THEN r END) AS BIGINT) AS risk_a, CAST(max(CASE WHEN scan_id = 1997 THEN r END) AS BIGINT) AS risk_b, max(CASE WHEN scan_id = 1996 THEN n END) AS act_now_a, max(CASE WHEN scan_id = 1997 THEN n END) AS act_now_b, CAST(max(CASE WHEN scan_id = 1997 THEN t END) - max(CASE WHEN scan_id = 1996 THEN t END) AS BIGINT) AS total_delta FROM s) SELECT *, CASE WHEN risk_b < risk_a THEN 'improved' WHEN risk_b > risk_a THEN 'regressed' ELSE 'unchanged' END AS posture FROM p")
def history_posture(spark, sf_dir):
    return history.posture(_history(spark, sf_dir), 1996, 1997)


# --- sinks -----------------------------------------------------------------------------------------------------------------------


@query()
def cbom_components(spark, sf_dir):
    return emit.cbom_components(inventory.with_occurrences(_assets(spark, sf_dir), _places(spark, sf_dir)))


@query(f"WITH {ASSETS}, r AS (SELECT p.family, p.key_size, p.mode, p.file, p.line FROM placed p) SELECT concat('crypto/', trim(regexp_replace(lower(a.family), '[^a-z0-9]+', '-', 'g'), '-')) AS rule, CASE a.severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'none' END AS level, r.file AS uri, greatest(r.line, 1) AS start_line, left(sha256(concat(a.asset_key, chr(9247), r.file, chr(9247), r.line)), 16) AS fingerprint FROM assets a JOIN r ON a.family = r.family AND a.key_size IS NOT DISTINCT FROM r.key_size AND a.mode IS NOT DISTINCT FROM r.mode")
def sarif_results(spark, sf_dir):
    return emit.sarif_results(_assets(spark, sf_dir), _places(spark, sf_dir))


@query(f"WITH {ASSETS}, wr AS (SELECT family, severity, count(*) OVER (PARTITION BY family) AS n_assets, CAST(sum(n_occ) OVER (PARTITION BY family) AS BIGINT) AS n_results, row_number() OVER (PARTITION BY family ORDER BY severity_rank DESC, score DESC) AS k FROM assets) SELECT family, concat('crypto/', trim(regexp_replace(lower(family), '[^a-z0-9]+', '-', 'g'), '-')) AS rule, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'none' END AS level, CASE severity WHEN 'critical' THEN '9.5' WHEN 'high' THEN '8.0' WHEN 'medium' THEN '5.5' WHEN 'low' THEN '3.0' ELSE '0.0' END AS security_severity, n_assets, n_results FROM wr WHERE k = 1")
def sarif_rules(spark, sf_dir):
    return emit.sarif_rules(_assets(spark, sf_dir))


@query(f"WITH {ASSETS}, t2 AS (SELECT CASE threat WHEN 'shor_broken' THEN 'BROKEN_Q' WHEN 'legacy_broken' THEN 'WEAK' WHEN 'pqc' THEN 'PQC' ELSE 'SAFE' END AS tier, n_occ, act_now FROM assets), n AS (SELECT tier, CAST(sum(n_occ) AS BIGINT) AS n, CAST(sum(CASE WHEN act_now THEN n_occ ELSE 0 END) AS BIGINT) AS n_urgent FROM t2 GROUP BY tier) SELECT *, round(100.0 * n / CAST(sum(n) OVER () AS DOUBLE), 1) AS pct FROM n")
def dashboard_tiers(spark, sf_dir):
    return emit.tiers(_assets(spark, sf_dir))


# --- names, versions, packages ------------------------------------------------------------------------------------------------------

SUITES = ["TLS_AES_256_GCM_SHA384", "TLS_CHACHA20_POLY1305_SHA256", "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", "ECDHE-ECDSA-AES256-GCM-SHA384", "DHE-RSA-AES256-SHA", "TLS_RSA_WITH_3DES_EDE_CBC_SHA", "TLS_RSA_WITH_RC4_128_MD5", "ADH-AES128-SHA256", "TLS_RSA_WITH_NULL_SHA", "AES128-SHA"]
#: What each suite is, written down by hand: kex, auth, bulk, bits, mode, mac, aead, forward_secrecy, anonymous.
SUITE_FACTS = [
    ("ECDHE", "certificate", "AES", 256, "GCM", "SHA-384", True, True, False),
    ("ECDHE", "certificate", "ChaCha20", 256, "Poly1305", "SHA-256", True, True, False),
    ("ECDHE", "RSA", "AES", 128, "GCM", "SHA-256", True, True, False),
    ("ECDHE", "ECDSA", "AES", 256, "GCM", "SHA-384", True, True, False),
    ("DHE", "RSA", "AES", 256, "CBC", "SHA-1", False, True, False),
    ("RSA", "RSA", "3DES", 168, "CBC", "SHA-1", False, False, False),
    ("RSA", "RSA", "RC4", 128, None, "MD5", False, False, False),
    ("DH", "none", "AES", 128, "CBC", "SHA-256", False, False, True),
    ("RSA", "RSA", "NULL", 0, None, "SHA-1", False, False, False),
    ("RSA", "RSA", "AES", 128, "CBC", "SHA-1", False, False, False),
]
_SUITE_COLUMNS = ["kex", "auth", "bulk", "bits", "mode", "mac", "aead", "forward_secrecy", "anonymous"]
_sql = lambda v: "NULL" if v is None else _q(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


@query("WITH f(suite, " + ", ".join(_SUITE_COLUMNS) + ") AS (VALUES " + ", ".join(f"({_q(s)}, " + ", ".join(map(_sql, r)) + ")" for s, r in zip(SUITES, SUITE_FACTS)) + ") SELECT s_suppkey, f.* FROM supplier, f")
def tls_suites(spark, sf_dir):
    s = corpus.table(spark, sf_dir, "supplier").select("s_suppkey").withColumn("suite", F.explode(F.array(*map(F.lit, SUITES))))
    return s.select("s_suppkey", "suite", *(c.alias(n) for n, c in N.suite(F.col("suite")).items()))


_NAMES = [
    ("openssl", "aes-256-gcm", "AES", 256, "GCM"), ("openssl", "des-ede3-cbc", "3DES", 168, "CBC"), ("openssl", "chacha20-poly1305", "ChaCha20", 256, "POLY1305"), ("openssl", "rc4", "RC4", None, None), ("openssl", "camellia-128-cbc", "Camellia", 128, "CBC"),
    ("java", "AES/GCM/NoPadding", "AES", None, "GCM"), ("java", "AES", "AES", None, "ECB"), ("java", "DESede/CBC/PKCS5Padding", "3DES", None, "CBC"), ("java", "RSA/ECB/PKCS1Padding", "RSA", None, None), ("java", "AES_256/CBC/PKCS5Padding", "AES", 256, "CBC"),
]


@query("WITH f(k, form, spelling, family, key_size, mode) AS (VALUES " + ", ".join(f"({i}, " + ", ".join(map(_sql, r)) + ")" for i, r in enumerate(_NAMES)) + f") SELECT p_partkey, form, spelling, family, CAST(key_size AS INTEGER) AS key_size, mode FROM part JOIN f ON k = p_partkey % {len(_NAMES)}")
def cipher_names(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_picked('p_partkey', [r[0] for r in _NAMES])} AS form", f"{_picked('p_partkey', [r[1] for r in _NAMES])} AS spelling")
    o, j = N.openssl_cipher(F.col("spelling")), N.java_transformation(F.col("spelling"))
    pick = lambda c: F.when(F.col("form") == "java", j[c]).otherwise(o[c]).alias(c)
    return d.select("p_partkey", "form", "spelling", pick("family"), pick("key_size"), pick("mode"))


_WORDS = [("jwt", "RS256", "RSA", "SHA-256"), ("jwt", "ES256K", "ECDSA", "SHA-256"), ("jwt", "none", "none", None), ("jwt", "EdDSA", "Ed25519", None), ("tls", "PROTOCOL_TLSv1_2", "TLSv1.2", None), ("tls", "SSLv3_method", "SSLv3", None), ("tls", "TLS", "TLS (unpinned)", None), ("hash", "SHA-512", "SHA-2", "512"), ("hash", "HmacSHA1", "SHA-1", "160"), ("hash", "sha256WithRSAEncryption", "SHA-2", "256"), ("hash", "SHA3-384", "SHA-3", "384"), ("hash", "shake256", "SHAKE", None)]


@query("WITH f(k, form, spelling, family, detail) AS (VALUES " + ", ".join(f"({i}, " + ", ".join(map(_sql, r)) + ")" for i, r in enumerate(_WORDS)) + f") SELECT p_partkey, form, spelling, family, detail FROM part JOIN f ON k = p_partkey % {len(_WORDS)}")
def algorithm_names(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_picked('p_partkey', [r[0] for r in _WORDS])} AS form", f"{_picked('p_partkey', [r[1] for r in _WORDS])} AS spelling")
    s, f = F.col("spelling"), F.col("form")
    w, h = N.jwt(s), N.hash_name(s)
    return d.select("p_partkey", "form", "spelling", F.when(f == "jwt", w["family"]).when(f == "tls", N.tls_version(s)).otherwise(h["family"]).alias("family"), F.when(f == "jwt", w["hash"]).when(f == "hash", h["digest_size"].cast("string")).alias("detail"))


_PKG = "k(ecosystem, package, family, hint, floor) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in T.PACKAGES) + ")"
_PICK = ["cryptography", "pycryptodome", "rsa", "leftpad", "paramiko", "bcrypt", "pyjwt"]


@query(f"WITH {_PKG}, d AS (SELECT p_partkey, CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN {_q(p)}" for i, p in enumerate(_PICK)) + " END AS package, concat(p_size, '.', p_partkey % 10) AS version, p_size, p_partkey % 10 AS minor FROM part) SELECT p_partkey, d.package, version, k.family, k.hint, CASE WHEN floor IS NOT NULL THEN (p_size, minor, 0) < (CAST(split_part(floor, '.', 1) AS INTEGER), CAST(split_part(floor, '.', 2) AS INTEGER), CAST(coalesce(nullif(split_part(floor, '.', 3), ''), '0') AS INTEGER)) END AS outdated FROM d JOIN k ON k.ecosystem = 'pypi' AND k.package = d.package")
def dependency_packages(spark, sf_dir):
    from .operators.detect import run

    p = corpus.table(spark, sf_dir, "part").selectExpr("p_partkey", f"element_at(array({', '.join(map(_q, _PICK))}), cast(p_partkey % 7 as int) + 1) AS package", "concat(p_size, '.', p_partkey % 10) AS version", "'pypi' AS ecosystem")
    return run.libraries(p).select("p_partkey", "package", "version", "family", "hint", "outdated")


# --- detectors on code; rows only ------------------------------------------------------------------------------------

CORPUS = {
    "app/keys.py": "import hashlib as h\nfrom cryptography.hazmat.primitives.asymmetric import rsa, ec\nBITS = 1024\nk = rsa.generate_private_key(public_exponent=65537, key_size=BITS)\ne = ec.generate_private_key(ec.SECP256R1())\nh.md5(b'x')\nh.sha256(b'y')\n# hashlib.sha1(b'no')\nraise ValueError('use DES')\n",
    "payments/pay.js": "const c = require('crypto');\nc.createHash('sha1');\nc.createCipheriv('aes-256-gcm', k, iv);\nc.generateKeyPairSync('rsa', { modulusLength: 2048 });\n// c.createHash('md5')\nthrow new Error('md5 is bad');\n",
    "src/auth/A.java": 'class A { void f() throws Exception { Cipher.getInstance("AES"); MessageDigest.getInstance("MD5"); Signature.getInstance("SHA256withRSA"); } }\n',
    "svc/main.go": 'package main\nimport ("crypto/md5"; "crypto/rsa"; "crypto/des")\nfunc f() { rsa.GenerateKey(r, 2048); md5.New() }\n',
    "lib/x.c": '#include <openssl/evp.h>\nvoid f() { EVP_aes_256_gcm(); EVP_md5(); RSA_generate_key_ex(r, 1024, e, 0); printf("RC4"); /* SHA1() */ }\n',
    "requirements.txt": "cryptography==41.0.1\nrequests\npycrypto==2.6\n",
    "config/id.pub": "ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAAIAABAgMEBQYHCAkKCwwNDg8QERITFBUWFxgZGhscHR4f me\n",
    "node_modules/p/v.js": "require('crypto').createHash('md5');\n",
}


def _scan(spark, sf_dir):
    """The plan over a tree with a folder for every supplier, each holding the files of ``CORPUS``."""
    from .plans import scan

    each = F.explode(F.map_from_arrays(F.array(*map(F.lit, CORPUS)), F.array(*map(F.lit, CORPUS.values()))))
    files = corpus.dealt(corpus.table(spark, sf_dir, "supplier"), corpus.TASK_ROWS // len(CORPUS)).select("s_suppkey", each.alias("name", "text"))
    content = F.encode("text", "UTF-8")
    return scan.of_files(spark, files.select(F.concat_ws("/", F.concat(F.lit("s"), "s_suppkey"), "name").alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("length")))


@query()
def detect_corpus(spark, sf_dir):
    return _scan(spark, sf_dir).findings


@query()
def scan_corpus(spark, sf_dir):
    return _scan(spark, sf_dir).assets


@query()
def patch_corpus(spark, sf_dir):
    from .plans import scan

    return scan.patches(_scan(spark, sf_dir))


# --- streaming --------------------------------------------------------------------------------------------------------------------------------


@query("WITH w AS (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_event_windows(spark, sf_dir):
    from .runtime import shared_folder
    from .streaming import watch

    home = shared_folder(spark, "stream")
    return watch.event_windows(spark, f"{sf_dir}/events.parquet", f"{home}/out", f"{home}/state")


# --- recorded endpoints -------------------------------------------------------------------------------------------------------------------------

_SEEN = [("https://A.example.com/x", "TLSv1.3", "TLS_AES_256_GCM_SHA384", "X25519MLKEM768"), ("b.example.com:8443", "TLSv1.2", "ECDHE-RSA-AES128-SHA", None), ("[2001:db8::1]:993", "TLSv1.0", "TLS_RSA_WITH_3DES_EDE_CBC_SHA", None)]
_TOLD = [
    ("tls://a.example.com:443", "TLS1.3", None, None), ("tls://a.example.com:443", "ML-KEM", None, None), ("tls://a.example.com:443", "AES", 256, "GCM"), ("tls://a.example.com:443", "SHA-2", 384, None),
    ("tls://b.example.com:8443", "TLS1.2", None, None), ("tls://b.example.com:8443", "ECDH", None, None), ("tls://b.example.com:8443", "AES", 128, "CBC"), ("tls://b.example.com:8443", "SHA-1", None, None),
    ("tls://2001:db8::1:993", "TLS1.0", None, None), ("tls://2001:db8::1:993", "RSA", None, None), ("tls://2001:db8::1:993", "3DES", 168, "CBC"), ("tls://2001:db8::1:993", "SHA-1", None, None),
]


_told = "WITH f(file, family, key_size, mode) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in _TOLD) + ")"


@query(f"{_told} SELECT replace(replace(file, '.example', concat('-', s_suppkey, '.example')), '2001:db8::', concat('2001:db8:', s_suppkey, '::')) AS file, family, CAST(key_size AS INTEGER) AS key_size, mode FROM supplier, f")
def tls_observations(spark, sf_dir):
    """Recorded handshakes of three endpoints of every supplier."""
    from .operators import observed

    seen = F.explode(F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for v, n in zip(r, ("endpoint", "version", "suite", "group")))) for r in _SEEN)))
    s = corpus.table(spark, sf_dir, "supplier").select("s_suppkey", seen.alias("x")).select("s_suppkey", "x.*")
    own = F.replace(F.replace("endpoint", F.lit(".example"), F.concat(F.lit("-"), "s_suppkey", F.lit(".example"))), F.lit("2001:db8::"), F.concat(F.lit("2001:db8:"), "s_suppkey", F.lit("::")))
    return observed.findings(s.select(own.alias("endpoint"), "version", "suite", "group")).select("file", "family", "key_size", "mode")


@query(f"WITH {ASSETS} SELECT uri, CASE WHEN uri LIKE '%.py' THEN 'python' END AS language FROM (SELECT DISTINCT p.file AS uri FROM placed p JOIN assets a ON a.family = p.family AND a.key_size IS NOT DISTINCT FROM p.key_size AND a.mode IS NOT DISTINCT FROM p.mode)")
def sarif_artifacts(spark, sf_dir):
    return emit.sarif_artifacts(_assets(spark, sf_dir), _places(spark, sf_dir))


@query(f"WITH {FOUND} SELECT file, line, lead_family, n_before FROM (SELECT file, line, scan_id, family AS lead_family, row_number() OVER (PARTITION BY file ORDER BY line, scan_id, family, confidence) AS n_before FROM (SELECT DISTINCT file, line, scan_id, family, confidence FROM found) x) WHERE n_before <= 6")
def report_first_places(spark, sf_dir):
    """The first six places of a file, as the report lists them."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line", "scan_id", "family", "confidence")
    d = corpus.findings(spark, sf_dir).select("file", "line", "scan_id", "family", "confidence").distinct()
    return d.withColumn("n_before", F.row_number().over(w).cast("long")).where("n_before <= 6").select("file", "line", F.col("family").alias("lead_family"), "n_before")


from . import queries_code  # noqa: E402,F401  registers its queries
