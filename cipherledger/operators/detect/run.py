"""Detectors over DataFrames of files; each is a narrow step."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ... import tables as T
from ...functions import text as X
from ...runtime import ship
from . import material, shapes

FIELDS = ["file", "line", "evidence", "detector", "confidence", "kind", "family", "name", "key_size", "curve", "mode", "padding", "not_after", "extra", "error"]
SCHEMA = "file string, line int, evidence string, detector string, confidence string, kind string, family string, name string, key_size int, curve string, mode string, padding string, not_after string, extra map<string,string>, error string"
_ARROW = {"line": pa.int32(), "key_size": pa.int32(), "extra": pa.map_(pa.string(), pa.string())}
_TYPES = pa.schema([(n, _ARROW.get(n, pa.string())) for n in FIELDS])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    """The rows as Arrow, a column at a time."""
    of = lambda n: [list(x.items()) if (x := r.get(n)) else None for r in rows] if n == "extra" else [r.get(n) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(of(n), t) for n, t in zip(FIELDS, _TYPES.types)], schema=_TYPES)


def sources(files: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Findings, and rows with only ``file`` and ``error``, of ``files (path, lang, text)``: the ``fields`` that are asked for, as no others
    are made. Findings are told once for each shape of a text (``shapes``) and put together a column at a time."""
    ship(files.sparkSession)
    types = [_TYPES.field(n) for n in fields]

    def run(batches):
        for b in batches:
            out = {n: [] for n in fields}
            for path, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                told, error = shapes.SHARED.detect(lang, text)
                own = {"file": [path] * len(told.found)}
                for n in fields:
                    out[n] += own[n] if n in own else told.evidence(text) if n == "evidence" else told.column(n)
                if error:
                    for n in fields:
                        out[n].append(path if n == "file" else error if n == "error" else None)
            yield pa.RecordBatch.from_arrays([pa.array(out[t.name], t.type) for t in types], schema=pa.schema(types))

    return files.select("path", "lang", "text").mapInArrow(run, ", ".join(SCHEMA.split(", ")[FIELDS.index(n)] for n in fields))


def material_files(files: DataFrame) -> DataFrame:
    """Keys and certificates in ``files (path, content)``; a marker in the bytes decides which are parsed at all."""
    ship(files.sparkSession)
    some = files.where((F.col("length") <= 8 << 20) & (F.contains("content", F.lit(b"-----BEGIN ")) | F.contains("content", F.lit(b"ssh-")) | F.contains("content", F.lit(b"ecdsa-sha2-")) | F.startswith("content", F.lit(b"0\x82"))))

    def run(batches):
        for b in batches:
            yield _batch([f | {"file": p} for p, c in zip(*(x.to_pylist() for x in b.columns)) for f in material.keys(c)])

    return some.select("path", "content").mapInArrow(run, SCHEMA)


def identifiers(files: DataFrame) -> DataFrame:
    """``file, identifier, family, name, curve, at, n``: the object identifiers of algorithms and curves in the bytes of ``files (path,
    content)`` that are neither text armour nor a certificate, with the first place and the number of each. One pass over the
    bytes for all identifiers."""
    ship(files.sparkSession)
    bare = files.where(~F.contains("content", F.lit(b"-----BEGIN ")))
    shape = "file string, identifier string, family string, name string, key_size int, curve string, at int, n int"

    def run(batches):
        names = [x.split(" ")[0] for x in shape.split(", ")]
        types = pa.schema([(n, pa.int32() if n in ("key_size", "at", "n") else pa.string()) for n in names])
        for b in batches:
            rows = [f | {"file": p} for p, c in zip(*(x.to_pylist() for x in b.columns)) if c and not material.readable(c) for f in material.identifiers(c)]
            yield pa.RecordBatch.from_pylist(rows, types)

    return bare.select("path", "content").mapInArrow(run, shape)


def dependencies(files: DataFrame) -> DataFrame:
    """``file, line, ecosystem, package, version`` of the manifests among ``files (path, text)``."""
    ship(files.sparkSession)

    def run(batches):
        names = ["file", "line", "ecosystem", "package", "version"]
        types = pa.schema([(n, pa.int32() if n == "line" else pa.string()) for n in names])
        for b in batches:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (p, i, e, k, v))) for p, t in zip(*(x.to_pylist() for x in b.columns)) for e, k, v, i in material.manifest(p, t or "")], types)

    own = files.where(F.col("path").rlike(material.MANIFEST)).select("path", "text")
    return own.mapInArrow(run, "file string, line int, ecosystem string, package string, version string")


def libraries(deps: DataFrame) -> DataFrame:
    """Dependencies that the package table knows, with ``family, hint`` and whether the version is below the floor: by exact
    name, and for Go modules by the longest known prefix. Others whose name has a word that tells a post-quantum scheme are
    guessed as that (``guessed``), by the first such word in order."""
    known = F.broadcast(T.packages(deps.sparkSession))  # a fixed table
    exact = (F.col("d.ecosystem") == F.col("k.ecosystem")) & ((F.col("d.package") == F.col("k.package")) | ((F.col("k.ecosystem") == "go") & F.col("d.package").startswith(F.concat("k.package", F.lit("/")))))
    hit = deps.alias("d").join(known.alias("k"), exact, "left").select("d.*", F.when(F.col("k.package").isNotNull(), F.struct(F.length("k.package").alias("n"), F.col("k.family").alias("family"), F.col("k.hint").alias("hint"), F.col("k.floor").alias("floor"))).alias("k"))
    best = hit.groupBy(*deps.columns).agg(F.max("k").alias("k"))
    word = pqc_word(F.col("package"))
    family = F
    for f, words in T.PQC_WORDS.items():
        family = family.when(word.isin(words.split()), f)
    guessed = F.col("k").isNull() & word.isNotNull()
    out = best.where(F.col("k").isNotNull() | guessed)
    return out.select(*deps.columns, F.coalesce("k.family", family.otherwise(None)).alias("family"), F.coalesce("k.hint", F.lit("pqc")).alias("hint"), X.version_below(F.col("version"), F.col("k.floor")).alias("outdated"), guessed.alias("guessed"))


def pqc_word(package: Column) -> Column:
    """The first word of a package's name, in order, that tells a post-quantum scheme, or null."""
    words = F.array(*(F.lit(w) for ws in T.PQC_WORDS.values() for w in ws.split()))
    return F.array_min(F.array_intersect(F.split(F.lower(package), "[^a-z0-9]+"), words))
