"""Where in a text a match lies: comments and strings as intervals, matches as offsets, and a range join of the two."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..runtime import ship, stored

#: Comments and strings of the C family and of scripts, whichever begins first; a quoted string ends in its line.
TOKEN = r"""//[^\n]*|#[^\n]*|/\*(?s:.*?)\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""
#: The same in parts: what opens one, and by that what it holds and what closes it.
OPENS = re.compile(r"""//|#|/\*|["'`]""")
HOLDS = {o: (re.compile(h), c) for o, h, c in [("//", r"[^\n]*", ""), ("#", r"[^\n]*", ""), ("/*", r"(?:[^*]+|\*(?!/))*+", "*/"), ('"', r'(?:[^"\\\n]+|\\.)*+', '"'), ("'", r"(?:[^'\\\n]+|\\.)*+", "'"), ("`", r"(?:[^`\\]+|\\.)*+", "`")]}
NEAR = 40  # characters before a string that say what is done with it
HANDED, TOLD = r"[=(\[,:]\s*$", r"(?i)(?:\b(?:raise|throw)\b[^;\n]*|(?:error|warn|log|print|console)[\w.]*\s*\(?\s*)$"
BLOCK = 4096  # characters


def intervals(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each ``TOKEN`` in ``text``, in time linear in it: what isn't closed is read once, as whatever opens in the same way
    up to there isn't closed either."""
    at, unclosed = 0, dict.fromkeys(HOLDS, 0)
    while m := OPENS.search(text, at):
        start, what, at = m.start(), m[0], m.start() + 1
        if start < unclosed[what]:
            continue
        holds, close = HOLDS[what]
        end = holds.match(text, m.end()).end()
        if text.startswith(close, end):
            at = end + len(close)
            yield start, at
        else:
            unclosed[what] = end


def located(files: DataFrame) -> DataFrame:
    """``path, kind, start, end, rule, handed`` of the comments, strings and rule matches of ``files (path, text)``. ``handed``:
    the string is assigned or passed on, not thrown or logged. One pass a text, linear in it; offsets are code points. Arrow's linear-time
    patterns pick the texts of a batch that a rule may match, so Python's, which give the offsets, read only these, and only for that rule."""
    ship(files.sparkSession)
    rules = [(r, rf"(?<![A-Za-z0-9_])(?:{w})(?![A-Za-z0-9_])" + (f"|{p}" if p else "")) for r, (w, p) in T.FLAT_WORDS.items()]  # offsets of the words
    picks = [rf"\b(?:{w})\b" + (f"|{p}" if p else "") for w, p in T.FLAT_WORDS.values()]  # every text that these match, and a few with long s or Kelvin signs

    def run(batches):
        handed, told = re.compile(HANDED), re.compile(TOLD)
        known = [(r, re.compile(p, re.I | re.A)) for r, p in rules]
        types = pa.schema([("path", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string()), ("handed", pa.bool_())])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)
        picked = lambda b, p: pc.match_substring_regex(b.column("text"), p, ignore_case=True)
        for b in batches:
            b = b.filter(picked(b, "|".join(picks)))  # nulls go too
            own = zip(*(picked(b, p).to_pylist() for p in picks))
            rows: list[tuple] = []
            for path, text, by in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), own):
                said = [(path, "match", m.start(), m.end(), r, None) for (r, p), may in zip(known, by) if may for m in p.finditer(text)]
                if not said:
                    continue  # intervals matter only where something lies in them
                rows += said
                for start, end in intervals(text):
                    comment = text[start] in "/#"
                    before = text[max(0, start - NEAR) : start]
                    rows.append((path, "comment" if comment else "string", start, end, None, None if comment else bool(handed.search(before)) and not told.search(before)))
                if len(rows) > 100_000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    return files.select("path", "text").mapInArrow(run, "path string, kind string, start int, end int, rule string, handed boolean")


def inside(points: DataFrame, spans: DataFrame, key: str = "path", at: str = "start") -> DataFrame:
    """``points (key, at, ...)`` with ``i_start, i_end, kind, handed`` of the interval of ``spans (key, start, end, kind, handed)``
    that each lies in, nulls where it lies in none. A range join of points with intervals that don't overlap: both sides are dealt to blocks of
    ``BLOCK`` characters of a text, an interval to each that it touches, so a point meets the intervals of its block only and a
    long text is many keys."""
    n = lambda c: F.floor(c / BLOCK)
    s = spans.select(F.col(key).alias("i_key"), F.explode(F.sequence(n(F.col("start")), n(F.greatest("start", F.col("end") - 1)))).alias("i_block"), F.col("start").alias("i_start"), F.col("end").alias("i_end"), "kind", "handed")
    p = points.withColumn("at_block", n(F.col(at)))
    on = (F.col(key) == F.col("i_key")) & (F.col("at_block") == F.col("i_block")) & (F.col(at) >= F.col("i_start")) & (F.col(at) < F.col("i_end"))
    return p.join(s, on, "left").drop("i_key", "i_block", "at_block")


def confidence(context: Column, handed: Column) -> Column:
    """A match in a comment is doubtful, one in a string counts if the string is handed on, anything else is code."""
    return F.when(context == "comment", "low").when(context == "string", F.when(handed, "high").otherwise("low")).otherwise("high")


def findings(files: DataFrame) -> DataFrame:
    """``path, start, end, rule, algorithm, tier, context, confidence``: the flat rules' matches in ``files``, judged by where they lie.
    What is located is stored, as both sides of the join read it: else each text would be read twice."""
    every = stored(located(files), "located")
    points = every.where("kind = 'match'").select("path", "start", "end", "rule")
    placed = inside(points, every.where("kind <> 'match'"))
    known = F.broadcast(files.sparkSession.createDataFrame([(r, a, t) for r, _, a, t, *_ in T.FLAT_RULES], "rule string, algorithm string, tier string"))  # a fixed table
    context = F.coalesce("kind", F.lit("code"))
    return placed.join(known, "rule").select("path", "start", "end", "rule", "algorithm", "tier", context.alias("context"), confidence(context, F.coalesce("handed", F.lit(False))).alias("confidence"))
