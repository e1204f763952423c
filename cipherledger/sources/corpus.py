"""Sources: file trees, text tables as files, lines, manifests, and findings derived from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import text as X

SOURCE_BYTES, LINE_CHARS = 2_000_000, 8_000
TASK_ROWS, TASKS = 4_000, 2_000
EXTENSIONS = {
    "python": ["py", "pyw"],
    "js": ["js", "mjs", "cjs", "ts", "tsx", "jsx"],
    "java": ["java"],
    "go": ["go"],
    "c": ["c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx", "inl"],
}

#: Findings derived from lineitem, as SQL that Spark and DuckDB both run.
FINDINGS = {
    "family": "CASE l_partkey % 8 WHEN 0 THEN 'RSA' WHEN 1 THEN 'AES' WHEN 2 THEN 'SHA-2' WHEN 3 THEN 'MD5' WHEN 4 THEN 'ECDSA' WHEN 5 THEN 'ML-KEM' WHEN 6 THEN '3DES' ELSE 'SHA-1' END",
    "key_size": "CAST(CASE l_partkey % 8 WHEN 0 THEN CASE CAST(floor(l_partkey / 8.0) AS BIGINT) % 3 WHEN 0 THEN 1024 WHEN 1 THEN 2048 END WHEN 1 THEN CASE l_suppkey % 3 WHEN 0 THEN 128 WHEN 1 THEN 256 END WHEN 2 THEN CASE l_suppkey % 2 WHEN 0 THEN 256 ELSE 384 END WHEN 5 THEN 768 END AS INTEGER)",
    "mode": "CASE WHEN l_partkey % 8 = 1 THEN CASE l_suppkey % 4 WHEN 0 THEN 'ECB' WHEN 1 THEN 'CBC' WHEN 2 THEN 'GCM' END END",
    "file": "concat(CASE l_suppkey % 8 WHEN 0 THEN 'payments/' WHEN 1 THEN 'src/auth/' WHEN 2 THEN 'docs/' WHEN 3 THEN 'tests/' WHEN 4 THEN 'lib/core/' WHEN 5 THEN 'svc/users/' WHEN 6 THEN 'node_modules/x/' ELSE 'public/' END, 'f', CAST(l_suppkey AS VARCHAR(20)), '.py')",
    "line": "l_linenumber",
    "confidence": "CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END",
    "detector": "l_linestatus",
    "scan_id": "CAST(year(l_shipdate) AS INTEGER)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, size: int = TASK_ROWS) -> DataFrame:
    """``rows`` of a compact table dealt evenly to tasks of about ``size`` rows, before texts are made of them: a row group of a million
    short rows would otherwise be one task for the parsers. More rows make more tasks, up to ``TASKS``, then longer ones."""
    return rows.repartition(max(1, min(TASKS, -(-rows.count() // size))))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in FINDINGS.items()))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, text``: documents, pages and conversations as a file tree."""
    d = table(spark, sf_dir, "documents").selectExpr("concat(source, '/', lang, '/', doc_id, '.txt') AS path", "text")
    p = table(spark, sf_dir, "pages").selectExpr("concat('pages/', page_id, '.html') AS path", "html AS text")
    c = table(spark, sf_dir, "conversations").selectExpr("concat('conv/', conv_id, '/', turn, '.txt') AS path", "text")
    return d.unionByName(p).unionByName(c)


def lines(files: DataFrame) -> DataFrame:
    """``path, line, text``: one row a line, numbered from 1."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")


def tree(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """``path, content, length`` of a file tree with paths relative to ``root`` (which may be one file); ignored directories
    and policy globs are left out before any content is read, as path and length are columns of the listing."""
    ignored = "(?:^|/)(?:" + "|".join(map(_escaped, T.IGNORED_DIRS)) + ")/"
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.when(plain == base, F.element_at(F.split(plain, "/"), -1)).otherwise(F.replace(plain, F.lit(base + "/"), F.lit("")))
    out = files.select(X.normal_path(rel).alias("path"), "content", "length").where(~F.col("path").rlike(ignored))
    for g in excludes or []:
        out = out.where(~(X.matches(F.col("path"), g) | X.matches(F.col("path"), g.rstrip("/") + "/**")))
    return out


def _escaped(x: str) -> str:
    return x.replace(".", r"\.")


def judged(files: DataFrame) -> DataFrame:
    """``files`` with ``lang`` (null for other files), ``text`` and ``why`` a source file isn't read: too large, binary, or with lines that only a
    machine writes. A narrow step."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    lang = F
    for name, xs in EXTENSIONS.items():
        lang = lang.when(ext.isin(xs), name)
    own = files.withColumn("lang", lang.otherwise(None))
    latin = F.decode("content", "ISO-8859-1")
    text = F.when(F.try_validate_utf8(F.col("content").cast("string")).isNotNull(), F.col("content").cast("string")).otherwise(latin)
    read = own.withColumn("text", F.when(F.col("lang").isNotNull() & (F.col("length") <= SOURCE_BYTES), text))
    # lines are told apart only in texts that may hold a long one
    longest = F.array_max(F.transform(F.split("text", "\n"), lambda x: F.length(x)))
    why = F.when(F.col("length") > SOURCE_BYTES, "too large").when(F.substring("text", 1, 4096).contains("\0"), "binary").when((F.length("text") > LINE_CHARS) & (longest > LINE_CHARS), "minified")
    return read.withColumn("why", F.when(F.col("lang").isNotNull(), why))


def sources(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, lang, text)`` of readable source files, and ``(source, message)`` of those left out."""
    own = judged(files).where("lang is not null")
    return own.where("why is null").select("path", "lang", "text"), own.where("why is not null").select(F.lit("source").alias("source"), F.concat_ws(": ", "path", "why").alias("message"))
