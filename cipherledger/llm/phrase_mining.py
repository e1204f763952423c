"""Operator 11. Phrase collocation mining by contiguous pattern growth (PrefixSpan).

Texts have A-Z lowered and are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, pieces into words (``[^\\x20\\x09]+``). Per language, f
counts the contiguous occurrences of a phrase within pieces. A frequent prefix is projected onto its occurrences, each of
which points at the words that follow it in its piece (at most ``longest - 1``, which travel with the pointer, as a task has
no other way to the text; equal ones of a batch are one row with a count). A task takes whole prefixes, in order, and grows
them to the right depth first: the rows of a prefix are those of its extensions one after the other, so that only one
count a depth is held, whatever a prefix's size. Extensions of a prefix that isn't frequent are not reported.

Hot prefixes: a prefix with more than 1 / ``SHARE`` of all places is grown by one word before it is dealt to tasks, again
and again. They are found by heavy hitters of batches (at most 2 ``SHARE`` rows a batch and word) and are at most 2
``SHARE`` a length, so the list is small by construction; missing or spare ones would cost time, not counts. Their own counts
are sums over their tasks.

Scores: of the cuts of a phrase into two parts with l and r occurrences, the lowest of floor(1000000 a^2 / (l r)), the first
of equal ones, in decimals of 38 digits. A phrase inside any longer candidate with at least half (``within`` hundredths) of its
occurrences is dropped. The best ``top`` of each language come from the best of ``SALTS`` parts of its phrases.

Null text is empty; a null lang is ``und``. Rows count as often as they are there, whatever their doc_id. Very long texts are
read whole, in overlapping parts. Ties go by occurrences, then by the phrase in byte order. Only lang and text are read, so
no other column can clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .packed import gathered, tidy

LONGEST, LEAST, TOP, WITHIN = 3, 10, 2000, 50
SHARE, SALTS = 1000, 64
PLACES = 1 << 20  # of one part of a batch; at most 2 ** 21 different words each
TEXT = 6 << 20  # bytes of batches that are taken together
ENDS, SPACES = "[.,;:!?\n-\r]", "[ \t]+"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TEXT:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and by word how many words of its piece begin there (itself included)."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), ENDS).flatten()
    lists = pc.split_pattern_regex(pieces, SPACES)
    flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    n = np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n))
    ends = np.repeat(np.cumsum(n), n)
    return flat.filter(pa.array(real)), ends - np.arange(n.sum())


class _Part:
    """Up to ``PLACES`` places of one language; the word at each and those behind it in its piece."""

    def __init__(self, words: pa.Array, left: np.ndarray, start: int, longest: int):
        self.n = min(PLACES, len(words) - start)
        d = words.slice(start, self.n + longest - 1).dictionary_encode()
        self.words = pa.concat_arrays([pa.array([""]), d.dictionary])
        ahead = np.r_[d.indices.to_numpy().astype(np.int64) + 1, np.zeros(longest, np.int64)]
        left = left[start : start + self.n]
        self.codes = [np.where(left > k, ahead[k : k + self.n], 0) for k in range(longest)]

    def counted(self, depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place of each different phrase of ``depth`` words (fewer at a piece's end) that starts ``at``, and their counts."""
        size, key, bits = len(self.words).bit_length(), np.zeros(len(at), np.int64), 0
        for k in range(depth):
            if bits + size > 63:  # ranks take the place of the words so far
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                bits = len(at).bit_length()
            key, bits = key << size | self.codes[k][at], bits + size
        _, one, count = np.unique(key, return_index=True, return_counts=True)
        return at[one], count

    def spelled(self, depth: int, at: np.ndarray) -> pa.Array:
        """The words of the phrases with a space between two; behind a piece's end they are empty."""
        return pc.binary_join_element_wise(*(self.words.take(pa.array(self.codes[k][at])) for k in range(depth)), " ")

    def growing(self, depth: int, at: np.ndarray) -> np.ndarray:
        return at[self.codes[depth - 1][at] > 0]


def _parts(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, _Part]]:
    for t in _gathered(batches):
        for lang in pc.unique(t["lang"]).to_pylist():
            words, left = _words(t.filter(pc.equal(t["lang"], lang))["text"].combine_chunks())
            for start in range(0, len(words), PLACES):
                yield lang, _Part(words, left, start, longest)


def _batch(lang: str, phrase: pa.Array, n: np.ndarray, depth: np.ndarray) -> pa.RecordBatch:
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([lang])).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, phrase, pa.array(n.astype(np.int64)), pa.array(depth.astype(np.int8))], ["lang", "phrase", "n", "depth"])


def heavy(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """The phrases with at least 1 / (2 ``SHARE``) of a part's places (``depth`` words), and its places (depth 0)."""
    for lang, part in _parts(batches, longest):
        yield _batch(lang, pa.array([""]), np.array([part.n]), np.zeros(1))
        at = np.arange(part.n)
        for depth in range(1, longest + 1):
            one, count = part.counted(depth, at := part.growing(depth, at))
            some = count * 2 * SHARE >= part.n
            yield _batch(lang, part.spelled(depth, one[some]), count[some], np.full(some.sum(), depth))
            alive = np.isin(part.codes[0][at], part.codes[0][one[some]])
            at = at[alive]


def projected(batches: Iterator[pa.RecordBatch], longest: int, hot: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    """The places of each part by the words from there on. depth: how many words name the task that takes the row."""
    for lang, part in _parts(batches, longest):
        at, count = part.counted(longest, np.arange(part.n))
        depth, grown = np.ones(len(at), np.int64), np.arange(len(at))
        known = pa.array(hot.get(lang, []), pa.string())
        for d in range(1, longest):
            grown = grown[pc.is_in(part.spelled(d, at[grown]), value_set=known).to_numpy(zero_copy_only=False)] if len(known) else grown[:0]
            depth[grown] = d + 1
        yield _batch(lang, part.spelled(longest, at), count, depth)


def _differ(a: pa.Array) -> np.ndarray:
    """Whether each value but the first is another than the one before."""
    return pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)


def _cut_up(phrases: pa.Array, longest: int) -> pa.Array:
    """The words of phrases that have ``longest`` words each (empty ones too), with the space behind each but the last: the
    same bytes with more offsets, nothing is copied."""
    _, offsets, data = phrases.buffers()
    ends = np.frombuffer(offsets, np.int32)[phrases.offset : phrases.offset + len(phrases) + 1]
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data else np.zeros(0, np.uint8)
    spaces = np.flatnonzero(raw[ends[0] :] == 32).astype(np.int32) + ends[0] + 1
    every = np.empty((len(phrases), longest), np.int32)
    every[:, 0] = ends[:-1]
    every[:, 1:] = spaces.reshape(len(phrases), longest - 1)
    return pa.StringArray.from_buffers(every.size, pa.py_buffer(np.r_[every.ravel(), ends[-1]].astype(np.int32)), data or pa.py_buffer(b""))


def grown(batches: Iterator[pa.RecordBatch], longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """The phrases with ``least`` occurrences or more, from projected rows in their order: ``lang, phrase, n``. Of prefixes
    grown before they were dealt, all counts. The last row, with the counts of its prefixes so far, is what is held."""

    def closed(t: pa.RecordBatch, counts: list[np.ndarray], last: bool):
        lang, phrase, depth = t["lang"], t["phrase"], t["depth"].to_numpy()
        words = _cut_up(phrase, longest)
        new = _differ(lang)
        carried, prefix = [], []
        for d in range(1, longest + 1):
            word = words.take(pa.array(np.arange(d - 1, len(words), longest)))
            new = new | _differ(word)
            start = np.r_[0, np.flatnonzero(new) + 1]
            total = np.add.reduceat(counts[d - 1], start)
            carried.append(total[-1:])
            prefix.append(word)
            some = (total >= least) | (depth[start] > d)
            some[-1] &= last
            start, total = start[some], total[some]
            real = pc.not_equal(pc.utf8_rtrim(word.take(pa.array(start)), " "), "").to_numpy(zero_copy_only=False)
            at = pa.array(start[real])
            spelled = pc.utf8_rtrim(pc.binary_join_element_wise(*(w.take(at) for w in prefix), ""), " ")
            out.append(pa.RecordBatch.from_arrays([lang.take(at), spelled, pa.array(total[real])], ["lang", "phrase", "n"]))
        return carried

    held, carried = None, None
    for t in gathered(batches):
        out: list[pa.RecordBatch] = []
        n = t["n"].to_numpy()
        counts = [n] * longest
        if held is not None:
            t = pa.concat_batches([held, t])
            counts = [np.concatenate([c, n]) for c in carried]
        carried = closed(t, counts, False)
        held = t.slice(t.num_rows - 1)
        yield from out
    if held is not None:
        out = []
        closed(held, carried, True)
        yield from out


def patterns(rows: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Of ``rows(lang, text)``: ``lang, phrase, f`` of all phrases of up to ``longest`` words with ``least`` occurrences or more,
    and ``lang, n``, the places of each language."""
    shape = "lang string, phrase string, n long, depth byte"
    found = stored(rows.mapInArrow(tidy(lambda it: heavy(it, longest)), shape).groupBy("lang", "phrase", "depth").agg(F.sum("n").alias("n")), "phrase-heavy")
    totals = found.where("depth = 0").select("lang", "n")
    places = totals.agg(F.sum("n")).first()[0] or 0
    hot: dict[str, list[str]] = {}
    for r in found.where(f"depth > 0 and depth < {longest} and n * {2 * SHARE} >= {places}").select("lang", "phrase").collect():  # 2 SHARE rows a length
        hot.setdefault(r.lang, []).append(r.phrase)
    dealt = rows.mapInArrow(tidy(lambda it: projected(it, longest, hot)), shape)
    tasks = dealt.repartition(F.expr("xxhash64(lang, substring_index(phrase, ' ', cast(depth as int)))"))
    own = tasks.sortWithinPartitions("lang", "phrase").mapInArrow(tidy(lambda it: grown(it, longest, least)), "lang string, phrase string, n long")
    return own.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), totals


def _words_of(c: Column | str) -> Column:
    return F.split(c, " ")


def scored(found: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of two words or more of ``found(lang, phrase, f)``, by their lowest cut."""
    cand = found.select("lang", "phrase", F.col("f").alias("a"), _words_of("phrase").alias("w")).where("size(w) > 1")
    cuts = cand.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("rest"))
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)), ["lang", part])
    wide = lambda c: f"cast({c} as decimal(15,0))"
    cuts = cuts.withColumn("score", F.expr(f"(1000000 * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def uncovered(cand: DataFrame, within: int) -> DataFrame:
    """``cand(lang, phrase, a)`` without phrases inside a longer one that has ``within`` hundredths of their occurrences."""
    longer = cand.select("lang", F.col("a").alias("f"), _words_of("phrase").alias("w")).where("size(w) > 2")
    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    most = longer.select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    return cand.join(most, ["lang", "phrase"], "left").where(f"f is null or 100 * f < {within} * a").drop("f")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, within: int = WITHIN) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found, totals = patterns(rows, longest, least)
    left = uncovered(scored(stored(found, "phrase-patterns")), within)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of two or three words of every language of all whole documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS ph FROM w, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k),
f AS (SELECT lang, k, ph, count(*) AS f FROM o GROUP BY ALL), n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, ph, f AS a, string_split(ph, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
parts AS (SELECT lang, k, ph, a, x, array_to_string(w[1:x], ' ') AS p1, array_to_string(w[x + 1:k], ' ') AS p2 FROM c, (VALUES (1), (2)) AS xs(x) WHERE x < k),
cuts AS (SELECT parts.lang, parts.k, parts.ph, a, x, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM parts JOIN f AS l ON l.lang = parts.lang AND l.ph = p1 JOIN f AS r ON r.lang = parts.lang AND r.ph = p2),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, x) = 1),
longer AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS ph, a FROM c WHERE k = 3),
inside AS (SELECT lang, ph, max(a) AS most FROM longer GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN inside AS i ON i.lang = s.lang AND i.ph = s.ph AND s.k = 2 WHERE most IS NULL OR 100 * most < {WITHIN} * a),
best AS (SELECT lang, ph AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank FROM kept)
SELECT best.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best JOIN n ON n.lang = best.lang WHERE rank <= {TOP}
"""
