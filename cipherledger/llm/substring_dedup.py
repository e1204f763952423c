"""Operator 12. Substring dedup: difference-cover anchors.

A window is ``window`` (35) consecutive words of one document; words are runs of characters other than blanks. Every word
that is covered by a window whose words also start anywhere else, in another document or in the same one, is removed;
windows are judged on the input, not on what is left.

Anchors: a difference cover D modulo a period v has, for any two places i and j, a shift s < v with i + s and j + s both in
D modulo v. So two equal windows share an aligned anchor: the ``window - v + 1`` words that start at a cover place. Only
these are hashed and shuffled (5 of 21 places, 15 words each). Anchors that repeat leave intervals of places at which a
repeated window may start; then the match is extended: whole windows are hashed at those places only (96 bits) and counted.
No pairs are made, so a passage that many documents share costs one row an occurrence, and equal anchors of one batch meet
before the shuffle: the first goes to the task of its hash, the others, known to repeat, to any. What comes back to the texts are intervals, a few a document;
they are broadcast while few (``BROADCAST`` documents and ``INTERVALS`` intervals), else joined by a shuffle. An anchor's hash
only proposes; a window counts as repeated if all 96 bits agree.

Null text has no words. Every row is a document of its own: rows with the same doc_id, or none, are told apart by their text,
and rows equal in both repeat each other's windows. Very long texts are read whole. Texts of fewer words than a window lose
nothing. Only id and text are read, so no other column can clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .packed import _odd, tidy

WINDOW = 35
BLANKS = "[ \t-\r]+"
# Perfect difference sets, period: places.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}
BROADCAST, INTERVALS = 1_000_000, 4_000_000  # documents and intervals, about 100 MB at most
KEYS = ["substring-anchor", "substring-window", "substring-widely"]  # 16 bytes each
OVER = 32
_NAMES = ["h", "k1", "k2", "at", "state"]


def period_of(window: int) -> int:
    """The longest period of ``COVERS`` that leaves anchors two fifths of a window."""
    return max(v for v in COVERS if v == 1 or v - 1 <= 0.6 * window)


class Words:
    """The words of a batch of texts, one after the other: ``hashes`` (two of 64 bits a word), ``first`` and ``n`` by text."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(texts, BLANKS)
        flat, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(n)), n)
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        self.flat = flat.filter(pa.array(real))
        self.n = np.bincount(doc[real], minlength=len(n)).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.doc = doc[real]

    def hashed(self, key: str) -> np.ndarray:
        d = self.flat.dictionary_encode()
        return hash_array(d.dictionary.to_numpy(zero_copy_only=False), hash_key=key, categorize=False)[d.indices.to_numpy()] if len(d) else np.zeros(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _runs_hash(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words from each place of ``at``."""
    out = np.zeros(len(at), np.uint64)
    for j, by in enumerate(_odd(length)):
        out += _mixed(hashes[at + j]) * by
    return _mixed(out)


def anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """``h, k1, k2, at, state`` of the anchors of texts ``k1, k2, text``. at: the anchor's place and by how much it lies behind
    the start of the text's last window (``OVER`` values). state: 0 once in the batch, 1 the first of several (h as it is), 2 the
    others of them (dealt anywhere; known to repeat)."""
    v = period_of(window)
    size = window - v + 1
    for b in batches:
        w = Words(b.column("text"))
        pos = np.arange(len(w.doc)) - w.first[w.doc]
        n = w.n[w.doc]
        here = np.flatnonzero(np.isin(pos % v, COVERS[v]) & (pos + size <= n) & (n >= window))
        h = _runs_hash(w.hashed(KEYS[0]), here, size)
        _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        state = np.where(count[back] > 1, 2, 0)
        state[first[count > 1]] = 1
        k1, k2 = (b.column(k).to_numpy()[w.doc[here]] for k in ("k1", "k2"))
        at = pos[here] * OVER + np.maximum(pos[here] + window - n[here], 0)
        spread = _mixed(_mixed(k1.view(np.uint64) + h) + at.astype(np.uint64))
        h = np.where(state == 2, spread, h)
        cols = [h.view(np.int64), k1, k2, at, state.astype(np.int8)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _NAMES)


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``k1, k2, at`` of the anchors that repeat, from rows of ``anchors`` in the order of h. Only the last row is held."""
    held = None
    for b in batches:
        cols = [b.column(c).to_numpy() for c in _NAMES]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        if not len(cols[0]):
            continue
        same = cols[0][1:] == cols[0][:-1]
        dup = cols[4] > 0
        dup[1:] |= same
        dup[:-1] |= same
        held = [x[-1:] for x in cols]
        held[4] = dup[-1:].astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][dup[:-1]]) for c in cols[1:4]], _NAMES[1:4])
    if held is not None and held[4][0]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[1:4]], _NAMES[1:4])


def _joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching intervals [start, end), sorted by start, made one."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]


def _per_row(batches, names, make):
    """``k1, k2, starts, ends`` for each row of lists; rows without intervals are left out."""
    for b in batches:
        out = []
        for row in zip(*(b.column(c) for c in ["k1", "k2", *names])):
            arrays = [np.sort(np.asarray(x.values.to_numpy() if x.is_valid else [], dtype=np.int64)) for x in row[2:]]
            s, e = make(*arrays)
            if len(s):
                out.append((row[0].as_py(), row[1].as_py(), s, e))
        k1, k2, s, e = zip(*out) if out else ([],) * 4
        ints = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(list(s), ints), pa.array(list(e), ints)], ["k1", "k2", "starts", "ends"])


def _places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())


def windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """``w1, w2, k1, k2, pos``: 96 bits of every window that starts in an interval of its text."""
    for b in batches:
        w = Words(b.column("text"))
        k1, k2 = (b.column(k).to_numpy() for k in ("k1", "k2"))
        starts, ends = b.column("starts"), b.column("ends")
        doc = np.repeat(np.arange(len(k1)), pc.list_value_length(starts).to_numpy())
        s, e = starts.flatten().to_numpy().astype(np.int64), ends.flatten().to_numpy().astype(np.int64)
        pos, doc = _places(s, e), np.repeat(doc, e - s)
        at = w.first[doc] + pos
        w1, w2 = (_runs_hash(w.hashed(key), at, window) for key in KEYS[1:])
        cols = [w1.view(np.int64), (w2 >> np.uint64(32)).astype(np.uint32).view(np.int32), k1[doc], k2[doc], pos]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["w1", "w2", "k1", "k2", "pos"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` as ``k1, k2, doc_id, text, m``: one row for each different row, m times there. Ids that are null or repeat are
    replaced by two hashes of id and text; ids that don't, which is read from the ids alone, need no shuffle of texts."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("k1"), F.lit(0).cast("bigint").alias("k2"), "doc_id", "text", F.lit(1).cast("bigint").alias("m"))
    keys = F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2")
    return stored(rows.select(*keys, "doc_id", "text").groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("m")), "substring-rows")


def _sized(few: DataFrame) -> DataFrame:
    """``few`` marked for broadcast if its rows and intervals are few enough."""
    n, k = few.agg(F.count("*"), F.sum(F.size("starts"))).first()
    return F.broadcast(few) if n <= BROADCAST and (k or 0) <= INTERVALS else few


def spans(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``k1, k2, starts, ends``: the intervals of words to remove, for the rows of ``keyed(k1, k2, text)`` that have some."""
    v = period_of(window)
    key, ints = ["k1", "k2"], "k1 long, k2 long, starts array<long>, ends array<long>"
    texts = keyed.select(*key, "text")
    found = texts.mapInArrow(tidy(lambda it: anchors(it, window)), "h long, k1 long, k2 long, at long, state byte")
    marks = found.repartition("h").sortWithinPartitions("h").mapInArrow(repeated, "k1 long, k2 long, at long")
    listed = marks.groupBy(*key).agg(F.collect_list("at").alias("at"))

    def proposed(at):
        x = at // OVER
        return _joined(np.maximum(x - v + 1, 0), x - at % OVER + 1)

    may = stored(listed.mapInArrow(lambda it: _per_row(it, ["at"], proposed), ints), "substring-places")
    whole = texts.join(_sized(may), key).mapInArrow(tidy(lambda it: windows(it, window)), "w1 long, w2 int, k1 long, k2 long, pos long")
    once = whole.groupBy("w1", "w2").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in (*key, "pos"))).where("n = 1")
    alone = once.groupBy(*key).agg(F.collect_list("pos").alias("alone"))

    def covered(starts, ends, alone):
        left = np.setdiff1d(_places(starts, ends), alone, assume_unique=True)
        return _joined(left, left + window)

    rows = may.join(alone, key, "left").select(*key, "starts", "ends", "alone")
    return stored(rows.mapInArrow(lambda it: _per_row(it, ["starts", "ends", "alone"], covered), ints), "substring-spans")


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, n_words, n_removed, kept``, m times for each row; ``kept`` is the words that stay, joined by one space."""
    for b in batches:
        w = Words(b.column("text"))
        starts, ends, m = b.column("starts"), b.column("ends"), b.column("m").to_numpy()
        doc = np.repeat(np.arange(len(m)), pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False))
        step = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(step, w.first[doc] + starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64), 1)
        np.add.at(step, w.first[doc] + ends.flatten().to_numpy(zero_copy_only=False).astype(np.int64), -1)
        gone = np.cumsum(step)[:-1] > 0
        gone |= (m[w.doc] > 1) & (w.n[w.doc] >= window)  # rows that repeat as a whole
        left = np.bincount(w.doc[~gone], minlength=len(m))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left)].astype(np.int32)), w.flat.filter(pa.array(~gone)))
        kept = pc.binary_join(lists, " ")
        again = np.repeat(np.arange(len(m)), m)
        for part in np.array_split(again, max(1, len(again) // 4096)):
            at = pa.array(part)
            cols = [b.column("doc_id").take(at), pa.array(w.n[part]), pa.array((w.n - left)[part]), kept.take(at)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept"])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs``: its words without those of repeated windows."""
    rows = _keyed(docs, doc_id, text)
    gone = spans(rows, window)
    both = rows.join(_sized(gone), ["k1", "k2"], "left").select("doc_id", "text", "m", "starts", "ends")
    return both.mapInArrow(tidy(lambda it: _kept(it, window)), "doc_id long, n_words long, n_removed long, kept string")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document without the windows of 35 words that start anywhere else too."""
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT k, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW}),
x AS (SELECT p.k, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM p JOIN d ON d.k = p.k),
g AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY s) AS c FROM x) WHERE c > 1),
r AS (SELECT DISTINCT k, unnest(range(i, i + {WINDOW})) AS j FROM g),
l AS (SELECT k, list(j) AS js FROM r GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string([w[j] FOR j IN range(1, len(w) + 1) IF js IS NULL OR NOT list_contains(js, j)], ' ')) AS kept_sha256
FROM d LEFT JOIN l ON l.k = d.k
"""
