"""Queries over source files derived from the driver's tables: detectors, and plans fed by them. The SQL says what is to be
found from the columns that the files are made of, not from the engine's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators.detect import run
from .queries import query
from .sources import code as C


def _found(spark, sf_dir, lang, *fields):
    return run.sources(C.files(spark, sf_dir, lang), [*fields, "error"]).where("error is null").select(*fields)


def _rows(*rows: str) -> str:
    """SQL: each ``line, family, ...`` list for every order."""
    return "SELECT concat('src/', o_orderkey) AS file, x.* FROM orders, LATERAL (" + " UNION ALL ".join(f"SELECT {r}" for r in rows) + ") AS x"


def _family(pair: str) -> str:
    return f"CASE {pair} WHEN 'DiffieHellman' THEN 'DH' WHEN 'RSASSA-PSS' THEN 'RSA' ELSE {pair} END"


_JAVA = _rows(
    f"3 AS line, {_family(C.PAIR_A)} AS family, {C.SIZE_A} AS key_size, NULL AS curve",
    f"4, {_family(C.PAIR_B)}, {C.SIZE_B}, NULL",
    f"9, 'EC', NULL, {C.CURVE_J}",
    f"11, 'AES', {C.BITS_J}, NULL",
)


@query(f"WITH f AS ({_JAVA}) SELECT file, CAST(line AS INTEGER) AS line, family, CAST(key_size AS INTEGER) AS key_size, curve, concat(family, '-', coalesce(CAST(key_size AS VARCHAR), curve)) AS name FROM f")
def detect_java_generators(spark, sf_dir):
    """Generators and the init that follows each, by variable, chained or with a parameter object in a variable."""
    return _found(spark, sf_dir, "java", "file", "line", "family", "key_size", "curve", "name")


_mode = lambda c: f"regexp_replace(regexp_replace({c}, '^New', ''), '(En|De)crypter$', '')"
_GO = _rows(
    f"4 AS line, 'AES' AS family, {C.GO_BYTES} * 8 AS key_size, {_mode(C.GO_MODE_A)} AS mode",
    f"6, '3DES', NULL, {_mode(C.GO_MODE_B)}",
    "10, 'Blowfish', NULL, NULL",
    f"11, CASE {C.GO_TLS} WHEN 'VersionTLS10' THEN 'TLS1.0' WHEN 'VersionTLS12' THEN 'TLS1.2' WHEN 'VersionTLS13' THEN 'TLS1.3' ELSE 'SSLv3' END, NULL, NULL",
)


@query(f"WITH f AS ({_GO}) SELECT file, CAST(line AS INTEGER) AS line, family, CAST(key_size AS INTEGER) AS key_size, mode FROM f")
def detect_go_handles(spark, sf_dir):
    """Cipher handles with the mode built on each, and the options of composites."""
    return _found(spark, sf_dir, "go", "file", "line", "family", "key_size", "mode")


_hash = lambda c: f"CASE {c} WHEN 'md5' THEN 'MD5' WHEN 'sha1' THEN 'SHA-1' ELSE 'SHA-2' END"
_curve = f"lower({C.PY_CURVE})"
_PYTHON = _rows(
    f"5 AS line, {_hash(C.PY_HASH)} AS family, 'medium' AS confidence, NULL AS curve",
    f"6, {_hash(C.PY_HASH)}, 'high', NULL",
    f"6, {_hash(C.PY_CALL)}, 'medium', NULL",
    f"7, 'ECDSA', 'medium', {_curve}",
    "8, '3DES', 'medium', NULL",
    f"9, 'ECDSA', 'high', {_curve}",
)


@query(f"WITH f AS ({_PYTHON}) SELECT file, CAST(line AS INTEGER) AS line, family, confidence, curve FROM f")
def detect_python_references(spark, sf_dir):
    """Algorithms that are named without a call, each once, beside those that are called."""
    return _found(spark, sf_dir, "python", "file", "line", "family", "confidence", "curve")


_JS = _rows(
    f"2 AS line, 'RSA' AS family, {C.JS_SIZE} AS key_size, NULL AS mode, CASE {C.JS_ALG} WHEN 'RSA-OAEP' THEN 'OAEP' WHEN 'RSA-PSS' THEN 'PSS' ELSE 'PKCS1v15' END AS padding, NULL AS iterations, 'SHA-256' AS hash",
    f"3, 'AES', 256, replace({C.JS_MODE}, 'AES-', ''), NULL, NULL, NULL",
    f"4, 'PBKDF2', NULL, NULL, NULL, {C.JS_ITER}, 'SHA-512'",
    f"5, CASE {C.JS_TLS} WHEN 'TLSv1' THEN 'TLS1.0' ELSE replace({C.JS_TLS}, 'TLSv', 'TLS') END, NULL, NULL, NULL, NULL, NULL",
    f"6, 'RSA', {C.JS_SIZE}, NULL, NULL, NULL, NULL",
)


@query(f"WITH f AS ({_JS}) SELECT file, CAST(line AS INTEGER) AS line, family, CAST(key_size AS INTEGER) AS key_size, mode, padding, CAST(iterations AS VARCHAR) AS iterations, hash FROM f")
def detect_js_objects(spark, sf_dir):
    """Parameters in object literals: the object's own properties, not those of objects inside or beside it."""
    f = _found(spark, sf_dir, "js", "file", "line", "family", "key_size", "mode", "padding", "extra")
    return f.select("file", "line", "family", "key_size", "mode", "padding", F.col("extra")["iterations"].alias("iterations"), F.col("extra")["hash"].alias("hash"))


# --- verdicts that depend on more than the family ---------------------------------------------------------------------------

_FACTS = {
    "family": C.pick("o_orderkey", "JWT", "TLS1.3", "TLS1.1", "PBKDF2", "3DES", "ChaCha20", "RSA", "ML-KEM", "SHA-2", "TLS1.2", "Unheard"),
    "alg": C.pick("o_custkey", "none", "RS256", "HS256", "ES384", "EdDSA", "own-alg", None),
    "groups": C.pick("o_custkey", "X25519MLKEM768", "x25519", "x25519_kyber768", None),
    "iterations": C.pick("o_custkey", 599999, 600000, 1000, None, 1000000),
    "padding": C.pick("o_custkey", "PKCS1v15", "OAEP", None),
    "mode": C.pick("o_custkey + 1", "ECB", None, "CTR"),
    "key_size": C.pick("o_custkey", 112, 256, 384, 512),
}


@query(
    "WITH f AS (SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in _FACTS.items()) + " FROM orders), "
    "v AS (SELECT *, CASE family WHEN 'RSA' THEN 'shor_broken' WHEN '3DES' THEN 'legacy_broken' WHEN 'TLS1.1' THEN 'legacy_broken' WHEN 'ML-KEM' THEN 'pqc' WHEN 'ChaCha20' THEN 'quantum_safe' "
    "WHEN 'SHA-2' THEN CASE WHEN key_size < 224 THEN 'legacy_broken' WHEN key_size < 384 THEN 'grover_weakened' ELSE 'quantum_safe' END "
    "WHEN 'PBKDF2' THEN CASE WHEN iterations < 600000 THEN 'grover_weakened' ELSE 'quantum_safe' END "
    "WHEN 'JWT' THEN CASE alg WHEN 'none' THEN 'legacy_broken' WHEN 'RS256' THEN 'shor_broken' WHEN 'ES384' THEN 'shor_broken' WHEN 'EdDSA' THEN 'shor_broken' WHEN 'HS256' THEN 'quantum_safe' ELSE 'unknown' END "
    "WHEN 'TLS1.2' THEN CASE WHEN groups IN ('X25519MLKEM768', 'x25519_kyber768') THEN 'pqc' ELSE 'shor_broken' END WHEN 'TLS1.3' THEN CASE WHEN groups IN ('X25519MLKEM768', 'x25519_kyber768') THEN 'pqc' ELSE 'shor_broken' END ELSE 'unknown' END AS plain FROM f) "
    "SELECT o_orderkey, family, CASE WHEN plain IN ('quantum_safe', 'grover_weakened', 'pqc') AND (coalesce(mode, '') = 'ECB' OR (coalesce(padding, '') = 'PKCS1v15' AND family <> 'RSA')) AND NOT (family = 'JWT' AND alg = 'RS256') THEN 'legacy_broken' ELSE plain END AS threat FROM v"
)
def kb_verdicts(spark, sf_dir):
    """Tokens by the algorithm they name, handshakes by their groups, key derivation by its iterations, and what a broken mode
    or padding does to a better verdict."""
    from .operators import classify
    from .sources import corpus

    f = corpus.table(spark, sf_dir, "orders").selectExpr("o_orderkey", *(f"{e} AS {n}" for n, e in _FACTS.items())).withColumn("name", F.col("family"))
    return classify.classified(f.withColumn("key_size", F.col("key_size").cast("int"))).select("o_orderkey", "family", "threat")


# --- matches in comments and strings ------------------------------------------------------------------------------------------


def _offsets(name: str, source: str, pattern: str, more: str = "") -> str:
    """SQL: rows of ``source (path, t)`` by match: its start and end, from the pieces between the matches."""
    from .queries import _q

    return (
        f"{name}0 AS (SELECT path, t, string_split_regex(t, {_q(pattern)}) AS g, regexp_extract_all(t, {_q(pattern)}) AS h FROM {source}), "
        f"{name}1 AS (SELECT path, t, unnest(h) AS what, unnest([length(x) FOR x IN h]) AS n, unnest([length(x) FOR x IN g[1:len(h)]]) AS gap, unnest(range(1, len(h) + 1)) AS i FROM {name}0 WHERE len(h) > 0), "
        f"{name} AS (SELECT path, t, what, CAST(sum(gap + n) OVER (PARTITION BY path ORDER BY i) - n AS INTEGER) AS s, CAST(sum(gap + n) OVER (PARTITION BY path ORDER BY i) AS INTEGER) AS e{more} FROM {name}1)"
    )


def _contexts() -> str:
    from . import tables as T
    from .operators import contexts as X
    from .queries import FILES, _q

    rules = [(r, rf"(?i)\b(?:{w})\b" + (f"|{p}" if p else ""), a, t) for r, _, a, t, *_ in T.FLAT_RULES for w, p in [T.FLAT_WORDS[r]]]
    found = ", ".join(_offsets(f"rule{k}_", "src", p, f", {_q(r)} AS rule, {_q(a)} AS algorithm, {_q(t)} AS tier") for k, (r, p, a, t) in enumerate(rules))
    every = " UNION ALL ".join(f"SELECT path, rule, algorithm, tier, s, e FROM rule{k}_" for k in range(len(rules)))
    before = f"substr(t, greatest(1, s - {X.NEAR} + 1), least({X.NEAR}, s))"
    return (
        f"WITH {FILES}, src AS (SELECT path, text AS t FROM files), {found}, m AS ({every}), {_offsets('i', '(SELECT * FROM src WHERE path IN (SELECT path FROM m))', X.TOKEN)}, "
        f"k AS (SELECT path, s, e, CASE WHEN regexp_matches(what, '^[/#]') THEN 'comment' ELSE 'string' END AS kind, regexp_matches({before}, {_q(X.HANDED)}) AND NOT regexp_matches({before}, {_q(X.TOLD)}) AS handed FROM i) "
        "SELECT m.path, m.s AS start, m.e AS \"end\", rule, algorithm, tier, coalesce(kind, 'code') AS context, CASE kind WHEN 'comment' THEN 'low' WHEN 'string' THEN CASE WHEN handed THEN 'high' ELSE 'low' END ELSE 'high' END AS confidence "
        "FROM m LEFT JOIN k ON k.path = m.path AND m.s >= k.s AND m.s < k.e"
    )


@query(_contexts())
def flat_contexts(spark, sf_dir):
    """The flat rules over all texts, each match judged by the comment or string that it lies in."""
    from .operators import contexts
    from .sources import corpus

    return contexts.findings(corpus.text_files(spark, sf_dir))


# --- merging with what contradicts nothing, extras ---------------------------------------------------------------------------------


def _merged_sql() -> str:
    from .queries import FOUND

    full = "SELECT DISTINCT family, key_size, mode FROM f"
    return (
        f"WITH {FOUND}, f AS (SELECT * FROM found WHERE file NOT LIKE 'node_modules/%'), c AS ({full}), n AS (SELECT *, CAST(key_size IS NOT NULL AS INTEGER) + CAST(mode IS NOT NULL AS INTEGER) AS known FROM c), "
        "best AS (SELECT family, max(known) AS top FROM n GROUP BY family), whole AS (SELECT n.* FROM n JOIN best ON best.family = n.family AND known = top), "
        "m AS (SELECT n.family, n.key_size, n.mode, w.key_size AS to_size, w.mode AS to_mode, row_number() OVER (PARTITION BY n.family, n.key_size, n.mode ORDER BY CASE WHEN w.key_size IS NOT DISTINCT FROM n.key_size AND w.mode IS NOT DISTINCT FROM n.mode THEN 0 ELSE 1 END, coalesce(CAST(w.key_size AS VARCHAR), 'None'), coalesce(w.mode, 'None')) AS r "
        "FROM n JOIN whole w ON w.family = n.family AND (n.key_size IS NULL OR n.key_size = w.key_size) AND (n.mode IS NULL OR n.mode = w.mode)) "
        "SELECT f.family, to_size AS key_size, to_mode AS mode, count(DISTINCT concat(file, ':', line)) AS n_occ, count(DISTINCT file) AS n_files FROM f JOIN m ON m.family = f.family AND m.key_size IS NOT DISTINCT FROM f.key_size AND m.mode IS NOT DISTINCT FROM f.mode AND r = 1 GROUP BY f.family, to_size, to_mode"
    )


@query(_merged_sql())
def merge_compatible(spark, sf_dir):
    """Assets after findings with fewer parameters joined the more specific ones, as the scan plan has them."""
    from .operators import merge
    from .plans import inventory
    from .sources import corpus

    found = inventory.compatible(corpus.findings(spark, sf_dir))
    return merge.assets(inventory.places(found), ["family", "key_size", "mode"]).drop("best_confidence")


_EXTRA = {"iterations": C.pick("o_custkey", "1000", "600000", None), "hash": C.pick("o_orderkey", "SHA-256", "SHA-1"), "group": C.pick("o_custkey", "x25519", None, None, "X25519MLKEM768")}


@query(
    "WITH f AS (SELECT " + C.pick("o_custkey", "PBKDF2", "TLS1.3", "HMAC") + " AS family, " + ", ".join(f'{e} AS "{k}"' for k, e in _EXTRA.items()) + " FROM orders), u AS (" + " UNION ALL ".join(f"SELECT DISTINCT family, '{k}' AS field, \"{k}\" AS v FROM f WHERE \"{k}\" IS NOT NULL" for k in _EXTRA) + ") "
    "SELECT family, field, string_agg(v, ',' ORDER BY v) AS said, count(*) AS n FROM u GROUP BY family, field"
)
def merge_extras(spark, sf_dir):
    """What findings say besides their parameters: one value, or all that contradict each other."""
    from .operators import merge
    from .sources import corpus

    pairs = ", ".join(f"'{k}', {e}" for k, e in _EXTRA.items())
    f = corpus.table(spark, sf_dir, "orders").selectExpr(C.pick("o_custkey", "PBKDF2", "TLS1.3", "HMAC") + " AS family", f"map({pairs}) AS extra")
    e = merge.extras(f, "family").select("family", F.explode("extra").alias("field", "vs"))
    return e.select("family", "field", F.array_join("vs", ",").alias("said"), F.size("vs").cast("long").alias("n"))


# --- identifiers in bytes ---------------------------------------------------------------------------------------------------------


def _identified():
    from .operators.detect import material as M

    names = list(M.SOUGHT)
    hexed = [M.encoded(k).hex().upper() for k in names]
    return M.SOUGHT, names, hexed


_SOUGHT, _OIDS, _HEX = _identified()
_BLOB = "concat('00FF', " + C.pick("c_custkey", "", "3082", "30") + ", " + C.pick("c_custkey", *_HEX) + ", '2B6570', " + C.pick("c_custkey", "", *_HEX) + ", " + C.pick("c_nationkey", "0500", *_HEX[:2]) + ")"
_oid_values = ", ".join(f"({i}, '{k}', '{f}', '{n}')" for i, (k, (f, n, *_)) in enumerate(_SOUGHT.items()))


@query(
    f"WITH k(i, identifier, family, name) AS (VALUES {_oid_values}), u AS (SELECT c_custkey, c_custkey % {len(_OIDS)} AS i FROM customer UNION ALL SELECT c_custkey, c_custkey % {len(_OIDS) + 1} - 1 FROM customer UNION ALL SELECT c_custkey, c_nationkey % 3 - 1 FROM customer) "
    "SELECT concat('blob/', c_custkey) AS file, identifier, family, name, CAST(count(*) AS INTEGER) AS n FROM u JOIN k ON k.i = u.i GROUP BY ALL"
)
def detect_identifiers(spark, sf_dir):
    """Object identifiers in bytes that are neither armoured nor a certificate."""
    from .sources import corpus

    blobs = corpus.dealt(corpus.table(spark, sf_dir, "customer")).selectExpr("concat('blob/', c_custkey) AS path", f"unhex({_BLOB}) AS content")
    return run.identifiers(blobs).select("file", "identifier", "family", "name", "n")


# --- guesses from package names -----------------------------------------------------------------------------------------------------

_NAME = "concat(" + C.pick("p_size", "lib-", "@org/", "", "my_") + ", " + C.pick("p_partkey", "kyber", "leftpad", "Dilithium", "sphincs", "pqc", "oqs", "hqc", "skyber", "rainbow") + ", " + C.pick("p_partkey + p_size", "-js", ".xmss", "", "_falcon", "/ntru") + ")"


@query(
    f"WITH p AS (SELECT p_partkey, {_NAME} AS package FROM part), w AS (SELECT p_partkey, package, unnest(string_split_regex(lower(package), '[^a-z0-9]+')) AS word FROM p), "
    "k AS (SELECT p_partkey, package, min(word) AS word FROM w WHERE word IN ('kyber','mlkem','dilithium','mldsa','falcon','sphincs','slhdsa','liboqs','oqs','pqcrypto','pqclean','ntru','saber','frodo','frodokem','mceliece','bike','hqc','xmss','picnic','rainbow','postquantum','pqc') GROUP BY ALL) "
    "SELECT p_partkey, package, CASE WHEN word IN ('kyber','mlkem','frodo','frodokem','ntru','saber','mceliece','bike','hqc') THEN 'ML-KEM' WHEN word IN ('dilithium','mldsa','falcon','rainbow','picnic') THEN 'ML-DSA' WHEN word IN ('sphincs','slhdsa','xmss') THEN 'SLH-DSA' ELSE 'PQC' END AS family, true AS guessed FROM k"
)
def dependency_guesses(spark, sf_dir):
    """Packages that no table knows and whose names tell a post-quantum scheme."""
    from .sources import corpus

    p = corpus.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_NAME} AS package", "'1.0' AS version", "'other' AS ecosystem")
    return run.libraries(p).select("p_partkey", "package", "family", "guessed")


# --- path rules by specificity --------------------------------------------------------------------------------------------------------

_RULES = [("*", "anything"), ("src/*", "source"), ("src/auth/**", "login"), ("**/users/*", "people"), ("f1*", "first"), ("payments/f?.*", "short payments"), ("docs/[!a-e]*", "papers"), ("*.java", "java")]


def _rules_sql() -> str:
    from .queries import FOUND

    # longest first: payments/f?.* (13), docs/[!a-e]* (12), src/auth/** (11), **/users/* (10), *.java (6), src/* (5), f1* (3), * (1)
    return (
        f"WITH {FOUND}, f AS (SELECT DISTINCT file, regexp_replace(file, '^.*/', '') AS base FROM found) SELECT file, CASE WHEN regexp_matches(file, '^payments/f.\\..*$') THEN 'short payments' WHEN regexp_matches(file, '^docs/[^a-e].*$') THEN 'papers' WHEN file LIKE 'src/auth/%' THEN 'login' "
        "WHEN file LIKE '%/users/%' THEN 'people' WHEN file LIKE '%.java' THEN 'java' WHEN file LIKE 'src/%' THEN 'source' WHEN base LIKE 'f1%' THEN 'first' ELSE 'anything' END AS rule FROM f"
    )


@query(_rules_sql())
def policy_specific_rules(spark, sf_dir):
    """Path rules of which the most specific one wins."""
    from .operators import policy
    from .sources import corpus

    f = corpus.findings(spark, sf_dir).select("file").distinct()
    return f.select("file", policy.most_specific(F.col("file"), _RULES, "none").alias("rule"))


# --- lines that moved -------------------------------------------------------------------------------------------------------------------

_CALL = C.pick("o_orderkey", "hashlib.md5(", "hashlib.sha1(", "createHash('md5')", "md5.New()")
#: The line that was found, after up to three lines that came in since; twice in some files, gone in others.
_MOVED = C.text("import x", "{{repeat(concat('# new', chr(10)), CAST(o_custkey % 4 AS INTEGER))}}v{{o_orderkey}} = {{CASE WHEN o_orderkey % 11 = 0 THEN 'sha256(' ELSE " + _CALL + " END}}b)", "{{CASE WHEN o_orderkey % 7 = 0 THEN concat('w = v', o_orderkey, ' = ', " + _CALL + ", 'b)') ELSE 'end' END}}")
_SITE = ["concat('src/', o_orderkey) AS file", "2 AS line", f"concat('v', o_orderkey, ' = ', {_CALL}, 'b)') AS evidence", "CASE WHEN o_orderkey % 4 = 1 THEN 'SHA-1' ELSE 'MD5' END AS family"]


@query(
    f"SELECT {', '.join(_SITE[:1])}, CAST(CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 3 + o_custkey % 4 END WHEN o_custkey % 4 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN NULL ELSE 2 + o_custkey % 4 END AS INTEGER) AS moved_to FROM orders"
)
def fix_moved_lines(spark, sf_dir):
    """Where a rewrite belongs after lines came in before it: the recorded line, else the only one that holds the evidence."""
    from .operators import recommend
    from .sources import corpus

    o = corpus.table(spark, sf_dir, "orders")
    lines = corpus.lines(o.selectExpr("concat('src/', o_orderkey) AS path", f"{_MOVED} AS text")).withColumnRenamed("path", "file")
    return recommend.located(o.selectExpr(*_SITE), lines).select("file", F.col("at").alias("moved_to"))


# --- history after a deletion --------------------------------------------------------------------------------------------------------------


def _kept_sql() -> str:
    from .queries import HISTORY

    return f"WITH {HISTORY} SELECT scan_id, asset_key, rank AS severity_rank, n_occ FROM hist WHERE scan_id <> 1996"


@query(_kept_sql())
def history_after_delete(spark, sf_dir):
    """All scans saved one by one, one of them deleted, and the rest read back and decoded."""
    from .operators import history
    from .queries import _history
    from .runtime import shared_folder

    home = shared_folder(spark, "scans")
    every = _history(spark, sf_dir).select("scan_id", "asset_key", "severity_rank", "n_occ")
    for (year,) in every.select("scan_id").distinct().orderBy("scan_id").collect():
        history.save(every.where(F.col("scan_id") == year).drop("scan_id"), home, str(year), "lineitem", str(year))
    history.delete(spark, home, "1996")
    rows = history.load(spark, home).select(F.col("scan_id").cast("int").alias("scan_id"), "data")
    return history.decoded(rows, "data", "asset_key string, severity_rank int, n_occ long").select("scan_id", "asset_key", "severity_rank", "n_occ")


# --- the whole plan over all four languages ---------------------------------------------------------------------------------------------


_SCANNED = " UNION ALL ".join(
    f"SELECT concat(file, '.{ext}') AS file, line, family, {size} AS key_size FROM ({sql})"
    for ext, sql, size in (("java", _JAVA, "key_size"), ("go", _GO, "key_size"), ("js", _JS, "key_size"), ("py", _PYTHON, "CASE WHEN line = 5 OR (line = 6 AND confidence = 'high') THEN " + C.pick("o", None, None, 512) + " WHEN line = 6 THEN " + C.pick("c", 256, None) + " END"))
)


def _scanned_sql() -> str:
    python = _PYTHON.replace("AS file, x.*", "AS file, o_orderkey AS o, o_custkey AS c, x.*")
    return f"WITH f AS ({_SCANNED.replace(_PYTHON, python)}) SELECT family, CAST(count(DISTINCT concat(file, ':', line, ':', coalesce(key_size, 0))) AS BIGINT) AS n_occ, count(DISTINCT file) AS n_files FROM f GROUP BY family"


@query(_scanned_sql())
def scan_code(spark, sf_dir):
    """Detectors, compatible merge, verdicts and scores over a tree of four files for every order; by family, places and files."""
    from .plans import scan

    ext = {"java": "java", "go": "go", "python": "py", "js": "js"}
    content = F.encode("text", "UTF-8")
    tree, orders = None, C.orders(spark, sf_dir)
    for lang, e in ext.items():
        part = C.files(spark, sf_dir, lang, orders).select(F.concat("path", F.lit(f".{e}")).alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("length"))
        tree = part if tree is None else tree.unionByName(part)
    done = scan.of_files(spark, tree)
    files = done.places.groupBy("family").agg(F.countDistinct("file").alias("n_files"))
    return done.assets.groupBy("family").agg(F.sum("n_occ").alias("n_occ")).join(files, "family")


# --- usage: signing or key establishment ------------------------------------------------------------------------------------------------

_SEEN = C.pick("o_custkey", "signer.sign(data)", "the design of a keyring", "rsa.encrypt(x)", "key = load(unsealed)", "JWT with RS256")
#: A few places say the opposite, which makes their asset ambiguous.
_EVIDENCE = f"CASE WHEN o_orderkey % 50 = 7 AND o_custkey % 20 IN (0, 12) THEN 'wrap and verify' ELSE {_SEEN} END"
_SIZE = "1024 + 128 * CAST(o_custkey % 20 AS INTEGER)"


@query(
    f"WITH f AS (SELECT o_custkey % 20 AS g, {_SIZE} AS key_size, o_orderkey % 50 = 7 AND o_custkey % 20 IN (0, 12) AS odd, o_orderkey FROM orders), a AS (SELECT g, key_size, bool_or(odd) AS odd, count(DISTINCT o_orderkey) AS n_occ FROM f GROUP BY g, key_size) "
    "SELECT CAST(key_size AS INTEGER) AS key_size, n_occ, CASE WHEN odd THEN NULL WHEN g % 5 IN (0, 4) THEN 'sign' WHEN g % 5 = 2 THEN 'kex' END AS usage, CASE WHEN odd OR g % 5 IN (1, 3) THEN 'AMBIGUOUS_USAGE' WHEN g % 5 = 2 THEN 'KEM_HYBRID' ELSE 'SIG_MLDSA' END AS rule_id FROM a"
)
def recommend_usage(spark, sf_dir):
    """Advice for keys by what the text around them does with them."""
    from .plans import inventory
    from .sources import corpus

    f = corpus.table(spark, sf_dir, "orders").selectExpr("'RSA' AS family", "concat('src/', o_orderkey) AS file", "1 AS line", "'high' AS confidence", "'d' AS detector", f"{_SIZE} AS key_size", f"{_EVIDENCE} AS evidence")
    return inventory.assets(f).select("key_size", "n_occ", "usage", "rule_id")


# --- calls of each language, a statement a line ---------------------------------------------------------------------------------------------


def _calls(lang: str):
    def found(spark, sf_dir):
        f = run.sources(C.call_files(spark, sf_dir, lang)).where("error is null")
        return f.select("file", "line", "family", "key_size", "curve", "mode")

    found.__name__, found.__doc__ = f"detect_{lang}_calls", f"Findings of {lang} statements, each with noise in comments and strings around it."
    return query(C.call_rows(lang))(found)


for _lang in C.CALLS:
    _calls(_lang)


# --- keys, manifests, files, policy, bill of materials ----------------------------------------------------------------------------------------

_KEY_BYTES, _SSH_BYTES = C.pick("c_custkey", 128, 256), C.pick("c_nationkey", 256, 128, 384)
_der = lambda n: f"concat('3082', lpad(hex({n} + 10), 4, '0'), '0282', lpad(hex({n} + 1), 4, '0'), '00', repeat('FF', {n}), '0203010001')"
_ssh = lambda n: f"concat('00000007', hex('ssh-rsa'), '00000003010001', lpad(hex({n} + 1), 8, '0'), '00', repeat('FF', {n}))"
_CURVE_KEY = C.pick("c_custkey", "70", "6E")  # Ed25519, X25519


@query(
    "SELECT concat('keys/', c_custkey) AS file, CAST(line AS INTEGER) AS line, 'key' AS kind, family, CAST(key_size AS INTEGER) AS key_size FROM (" + " UNION ALL ".join([
        "SELECT c_custkey, 2 AS line, " + C.pick("c_custkey", "Ed25519", "X25519") + " AS family, 256 AS key_size FROM customer",
        f"SELECT c_custkey, 5, 'RSA', 8 * {_SSH_BYTES} FROM customer",
        f"SELECT c_custkey, 6, 'RSA', 8 * {_KEY_BYTES} FROM customer",
        "SELECT c_custkey, 9, 'EC', NULL FROM customer",
    ]) + ")"
)
def detect_keys(spark, sf_dir):
    """Keys in text armour and of SSH, with sizes read from their bytes; one whose armour holds no key."""
    from .sources import corpus

    parts = [
        "'note\n-----BEGIN PUBLIC KEY-----\n'", f"base64(unhex(concat('302a300506032b65', {_CURVE_KEY}, '032100', sha2(cast(c_custkey AS STRING), 256))))", "'\n-----END PUBLIC KEY-----\nssh-rsa '", f"replace(base64(unhex({_ssh(_SSH_BYTES)})), chr(13) || chr(10), '')",
        "' me\n-----BEGIN RSA PUBLIC KEY-----\n'", f"replace(base64(unhex({_der(_KEY_BYTES)})), chr(13) || chr(10), '')", "'\n-----END RSA PUBLIC KEY-----\n-----BEGIN EC PRIVATE KEY-----\nAA==\n-----END EC PRIVATE KEY-----\n'",
    ]
    body = "replace(concat(" + ", ".join(parts) + "), '\r', '')"
    files = corpus.dealt(corpus.table(spark, sf_dir, "customer")).selectExpr("concat('keys/', c_custkey) AS path", f"encode({body}, 'UTF-8') AS content").withColumn("length", F.octet_length("content").cast("long"))
    return run.material_files(files).select("file", "line", "kind", "family", "key_size")


_VERSION = "concat(s_nationkey, '.', s_suppkey % 10)"
_MANIFESTS = {
    "requirements.txt": (C.text("# cryptography==1", "Py_NaCl=={{" + _VERSION + "}}", "", "requests[security]", "pycryptodome>={{" + _VERSION + "}} ; python_version>'3'"), [("pypi", "py-nacl", _VERSION, 2), ("pypi", "requests", "NULL", 4), ("pypi", "pycryptodome", _VERSION, 5)]),
    "package.json": (C.text("{", '"dependencies": {"node-rsa": "^{{' + _VERSION + '}}"},', '"devDependencies": {"md5": "~{{' + _VERSION + '}}"}', "}"), [("npm", "node-rsa", _VERSION, 2), ("npm", "md5", _VERSION, 3)]),
    "go.mod": (C.text("module m", "require (", "\tgolang.org/x/crypto v{{" + _VERSION + "}}", ")", "require github.com/cloudflare/circl v{{" + _VERSION + "}}"), [("go", "golang.org/x/crypto", _VERSION, 3), ("go", "github.com/cloudflare/circl", _VERSION, 5)]),
    "Cargo.toml": (C.text("[package]", 'ring = "9"', "[dependencies]", 'ring = "{{' + _VERSION + '}}"', 'rsa = { version = "{{' + _VERSION + '}}" }'), [("cargo", "ring", _VERSION, 4), ("cargo", "rsa", _VERSION, 5)]),
    "pom.xml": (C.text("<project><properties><v>{{" + _VERSION + "}}</v></properties>", "<dependency><artifactId>bcprov-jdk18on</artifactId><version>{{chr(36)}}{v}</version></dependency>", "</project>"), [("maven", "bcprov-jdk18on", _VERSION, 2)]),
    "build.gradle": (C.text("plugins { id 'java' }", "implementation 'com.google.crypto.tink:tink:{{" + _VERSION + "}}'"), [("maven", "tink", _VERSION, 2)]),
}


@query("SELECT file, CAST(line AS INTEGER) AS line, ecosystem, package, version FROM (" + " UNION ALL ".join(f"SELECT concat('s', s_suppkey, '/{f}') AS file, {i} AS line, '{e}' AS ecosystem, '{p}' AS package, CAST({v} AS VARCHAR) AS version FROM supplier" for f, (_, rows) in _MANIFESTS.items() for e, p, v, i in rows) + ")")
def dependency_manifests(spark, sf_dir):
    """What the manifests of six ecosystems declare."""
    from .sources import corpus

    s = corpus.dealt(corpus.table(spark, sf_dir, "supplier"))
    files = None
    for name, (body, _) in _MANIFESTS.items():
        part = s.selectExpr(f"concat('s', s_suppkey, '/{name}') AS path", f"{body} AS text")
        files = part if files is None else files.unionByName(part)
    return run.dependencies(files).select("file", "line", "ecosystem", "package", "version")


_EXT = C.pick("c_custkey", "py", "js", "java", "go", "cpp", "txt", "TSX")
_WHY = "CASE WHEN c_custkey % 7 = 5 THEN NULL WHEN c_custkey % 11 = 3 THEN 'too large' WHEN c_custkey % 13 = 4 THEN 'binary' WHEN c_custkey % 5 = 2 THEN 'minified' END"


@query(
    f"SELECT concat('f', c_custkey, '.', {_EXT}) AS path, CASE WHEN {_WHY} IS NULL THEN " + C.pick("c_custkey", "python", "js", "java", "go", "c", None, "js") + f" END AS lang, {_WHY} AS why, "
    f"CASE WHEN {_WHY} IS NULL THEN CASE WHEN c_custkey % 3 = 0 THEN 'é' ELSE 'x' END END AS head FROM customer WHERE c_custkey % 7 <> 5"
)
def source_files(spark, sf_dir):
    """Which files are read as source, in which language and encoding, and why others aren't."""
    from .sources import corpus

    content = "CASE WHEN c_custkey % 13 = 4 THEN unhex('780041') WHEN c_custkey % 5 = 2 THEN encode(repeat('x', 8001), 'UTF-8') WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN unhex('E9') ELSE unhex('C3A9') END ELSE encode('x', 'UTF-8') END"
    files = corpus.table(spark, sf_dir, "customer").selectExpr(f"concat('f', c_custkey, '.', {_EXT}) AS path", f"{content} AS content", "CAST(CASE WHEN c_custkey % 11 = 3 THEN 2000001 ELSE 9 END AS BIGINT) AS length")
    texts, skipped = corpus.sources(files)
    good = texts.select("path", "lang", F.lit(None).cast("string").alias("why"), F.left("text", F.lit(1)).alias("head"))
    return good.unionByName(skipped.select(F.substring_index("message", ": ", 1).alias("path"), F.lit(None).cast("string").alias("lang"), F.substring_index("message", ": ", -1).alias("why"), F.lit(None).cast("string").alias("head")))


_POLICY = """
mosca: {default_X_protection_years: 11}
data_classes: {guarded: {X_protection_lifetime: 33}, financial: 16}
data_class_paths: {"payments/**": guarded, "**/f1*": financial, "docs/**": nowhere}
business_criticality: {"svc/**": 0.45, "**/f2*": 7}
"""


def _policy_sql() -> str:
    from .queries import FOUND

    # the last rule that matches wins; an undeclared class is the default one; weights are held within 0 and 1
    name = "regexp_replace(file, '^.*/', '')"
    own = "CASE WHEN file LIKE 'docs/%' THEN 'default' WHEN " + name + " LIKE 'f1%' THEN 'financial' WHEN file LIKE 'payments/%' THEN 'guarded' WHEN file LIKE '%auth/%' THEN 'credential' WHEN file LIKE '%users/%' THEN 'pii' WHEN file LIKE 'public/%' THEN 'public' ELSE 'default' END"
    weight = "CASE WHEN " + name + " LIKE 'f2%' THEN 1.0 WHEN file LIKE 'svc/%' THEN 0.45 WHEN file LIKE 'docs/%' THEN 0.05 WHEN file LIKE 'tests/%' THEN 0.1 WHEN file LIKE 'lib/core/%' THEN 0.7 WHEN file LIKE '%auth/%' THEN 0.9 WHEN file LIKE 'payments/%' THEN 1.0 ELSE 0.3 END"
    years = "CASE data_class WHEN 'guarded' THEN 33 WHEN 'financial' THEN 16 WHEN 'credential' THEN 12 WHEN 'pii' THEN 25 WHEN 'public' THEN 0 ELSE 11 END"
    return f"WITH {FOUND}, p AS (SELECT DISTINCT file FROM found), c AS (SELECT file, {own} AS data_class, CAST({weight} AS DOUBLE) AS weight FROM p) SELECT file, data_class, CAST({years} AS INTEGER) AS x_years, weight FROM c"


@query(_policy_sql())
def policy_file_places(spark, sf_dir):
    """Paths placed by a policy file that overlays the default one."""
    from .operators import policy
    from .plans.policy_file import Policy
    from .sources import corpus

    p = Policy.loads(_POLICY)
    f = corpus.findings(spark, sf_dir).select("file").distinct()
    return policy.placed(f, classes=p.class_rules, criticality=p.criticality_rules, years=p.classes, default=p.default_x).select("file", "data_class", "x_years", "weight")


def _cbom_sql() -> str:
    from .queries import ASSETS

    return (
        f"WITH {ASSETS}, o AS (SELECT family, key_size, mode, count(*) AS n FROM placed WHERE line > 0 GROUP BY ALL) SELECT asset_key, concat('crypto/', trim(regexp_replace(lower(a.family), '[^a-z0-9]+', '-', 'g'), '-'), '/', substr(sha256(asset_key), 1, 16)) AS bom_ref, 'cryptographic-asset' AS type, a.family AS name, "
        "CASE WHEN a.family IN ('RSA', 'ECDSA', 'ML-KEM') THEN 'pke' WHEN a.family IN ('AES', '3DES') THEN 'block-cipher' ELSE 'hash' END AS primitive, CAST(a.key_size AS VARCHAR) AS size, lower(a.mode) AS mode, threat, severity, o.n AS n_places "
        "FROM assets a JOIN o ON o.family = a.family AND o.key_size IS NOT DISTINCT FROM a.key_size AND o.mode IS NOT DISTINCT FROM a.mode"
    )


@query(_cbom_sql())
def cbom_fields(spark, sf_dir):
    """The components of the bill of materials, read back from their JSON."""
    from .operators import emit
    from .plans import inventory
    from .queries import _assets, _places

    shape = "type string, `bom-ref` string, name string, cryptoProperties struct<algorithmProperties: struct<primitive: string, parameterSetIdentifier: string, mode: string>>, properties array<struct<name: string, value: string>>, evidence struct<occurrences: array<struct<location: string, line: int>>>"
    c = emit.cbom_components(inventory.with_occurrences(_assets(spark, sf_dir), _places(spark, sf_dir))).select("asset_key", "bom_ref", F.from_json("component", shape).alias("c"))
    prop = lambda n: F.get(F.filter("c.properties", lambda p: p["name"] == f"crypto:{n}"), F.lit(0))["value"].alias(n)
    a = F.col("c.cryptoProperties.algorithmProperties")
    return c.select("asset_key", "bom_ref", "c.type", "c.name", a["primitive"].alias("primitive"), a["parameterSetIdentifier"].alias("size"), a["mode"].alias("mode"), prop("threat"), prop("severity"), F.size("c.evidence.occurrences").cast("long").alias("n_places"))


# --- validity, help texts, lists, escalation ---------------------------------------------------------------------------------------------------

_FROM = "CAST('2020-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * CAST(o_custkey % 700 AS INTEGER)"
_TO = "CAST('2024-06-01 12:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * CAST(o_orderkey % 9000 - 4000 AS INTEGER)"


@query(
    f"WITH v AS (SELECT o_orderkey, CAST(floor(date_diff('second', TIMESTAMP '2024-06-01 12:00:00', {_TO}) / 86400.0) AS INTEGER) AS days_left, CAST(floor(date_diff('second', {_FROM}, {_TO}) / 86400.0) AS INTEGER) AS whole FROM orders) "
    "SELECT o_orderkey, days_left, concat_ws(', ', CASE WHEN days_left < 0 THEN concat('EXPIRED ', -days_left, 'd ago') WHEN days_left <= 90 THEN concat('EXPIRES IN ', days_left, 'd') END, CASE WHEN whole > 398 THEN concat('long-lived (', whole, 'd validity)') END) AS said FROM v"
)
def certificate_validity(spark, sf_dir):
    """Days to expiry and what is remarkable about a validity."""
    from .functions import validity
    from .sources import corpus

    o = corpus.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_FROM} AS not_before", f"{_TO} AS not_after")
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    return o.select("o_orderkey", validity.days(now, F.col("not_after")).alias("days_left"), validity.flags(F.col("not_before"), F.col("not_after"), now).alias("said"))


def _help_sql() -> str:
    from .queries import _ADVICE, _RULE, ASSETS

    pick = lambda c, n: f"(SELECT string_agg(t, ' | ' ORDER BY o) FROM (SELECT t, o, row_number() OVER (ORDER BY o) AS r FROM (SELECT {c} AS t, min(k) AS o FROM hw WHERE hw.family = hf.family GROUP BY {c})) WHERE r <= {n})"
    return (
        f"WITH {ASSETS}, {_ADVICE}, hj AS (SELECT *, {_RULE} AS rule_id FROM assets), hw AS (SELECT family, recommendation, concat(family, ' seen ', n_occ, ' times in ', n_files, ' files, first at ', file, ':', line) AS rationale, "
        "row_number() OVER (ORDER BY severity_rank DESC, score DESC, family, asset_key) AS k FROM hj JOIN advice USING (rule_id)), hf AS (SELECT DISTINCT family FROM hw) "
        f"SELECT family, {pick('recommendation', 8)} AS recommendations, {pick('rationale', 5)} AS rationales FROM hf"
    )


@query(_help_sql())
def sarif_help(spark, sf_dir):
    """The first different recommendations and rationales of each family's rule."""
    from .operators import emit
    from .queries import _assets

    h = emit.sarif_help(_assets(spark, sf_dir))
    return h.select("family", F.array_join("recommendations", " | ").alias("recommendations"), F.array_join("rationales", " | ").alias("rationales"))


def _flat_sql(rest: str) -> str:
    from .queries import FLAT

    return f"WITH {FLAT} {rest}"


@query(_flat_sql("SELECT path, line, rule, tier, urgent FROM urgent WHERE confidence = 'high' ORDER BY list_position(['BROKEN_Q', 'WEAK', 'SAFE', 'PQC'], tier), urgent DESC, path, line, rule LIMIT 12"))
def flat_command_line(spark, sf_dir):
    """The twelve matches that the command line shows."""
    from .operators import flat
    from .queries import _flat

    return flat.command_line(_flat(spark, sf_dir)).select("path", "line", "rule", "tier", "urgent")


def _scan_sql() -> str:
    from .queries import ASSETS

    return f"WITH {ASSETS} SELECT asset_key, severity, CAST(row_number() OVER (ORDER BY severity_rank DESC, score DESC, lower(family), asset_key) AS INTEGER) AS place FROM assets"


@query(_scan_sql())
def history_scan(spark, sf_dir):
    """One scan's assets in the order in which history gives them."""
    from .operators import history
    from .queries import _assets

    two = _assets(spark, sf_dir).withColumn("scan_id", F.explode(F.array(F.lit("1"), F.lit("2"))))
    return history.scan(two, "2").select("asset_key", "severity", "place")


_GLOBS = ["payments/**", "**/auth/**", "f1*", "src/*/*", "**"]


def _matched_sql() -> str:
    from .queries import FOUND

    name = "regexp_replace(file, '^.*/', '')"
    tests = ["file LIKE 'payments/%'", "regexp_matches(file, '(^|/)auth/')", f"{name} LIKE 'f1%'", "regexp_matches(file, '^src/[^/]*/[^/]*$')", "true"]
    said = ", ".join(f"CASE WHEN {t} THEN '{g}' END" for t, g in zip(tests, _GLOBS))
    return f"WITH {FOUND}, p AS (SELECT DISTINCT file FROM found) SELECT file, concat_ws(',', {said}) AS rules FROM p WHERE NOT (file LIKE 'docs/%' OR {name} LIKE '%7.%')"


@query(_matched_sql())
def policy_matched_rules(spark, sf_dir):
    """Paths that no ignore glob names, with the rules that match each."""
    from .operators import policy
    from .sources import corpus

    f = policy.kept(corpus.findings(spark, sf_dir).select("file").distinct(), ["docs", "*7.*"])
    return f.select("file", F.array_join(policy.matched_rules(F.col("file"), _GLOBS), ",").alias("rules"))


@query(
    "WITH a AS (SELECT o_orderkey, " + C.pick("o_custkey", "algorithm", "key", "certificate") + " AS kind, CAST(" + C.pick("o_orderkey", 1.0, 0.85, 0.6, 0.3, 0.1) + " AS DOUBLE) AS weight FROM orders), "
    "l AS (SELECT o_orderkey, kind, CASE weight WHEN 1.0 THEN 0 WHEN 0.85 THEN 1 WHEN 0.6 THEN 2 WHEN 0.3 THEN 3 ELSE 4 END AS i FROM a) "
    "SELECT o_orderkey, kind, ['critical', 'high', 'medium', 'low', 'none'][1 + CASE WHEN kind = 'algorithm' THEN i ELSE greatest(i - 1, 0) END] AS criticality FROM l"
)
def risk_escalated(spark, sf_dir):
    """Criticality of key material, a step higher where the policy asks for it."""
    from .functions import risk_math
    from .operators import risk
    from .sources import corpus

    a = corpus.table(spark, sf_dir, "orders").selectExpr("o_orderkey", C.pick("o_custkey", "algorithm", "key", "certificate") + " AS kind", "CAST(" + C.pick("o_orderkey", 1.0, 0.85, 0.6, 0.3, 0.1) + " AS DOUBLE) AS weight")
    return a.select("o_orderkey", "kind", risk.escalated(risk_math.label(F.col("weight")), F.col("kind")).alias("criticality"))
