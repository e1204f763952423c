"""Operator 13. Spelling variant grouping: the trie of all words with one error (errata-trie merging).

Words are maximal runs of letters ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lowered, ``shortest`` (5) code points or more, that occur
``least`` (3) times or more. Two words are near if they differ by one inserted, deleted or replaced code point. They leave a
common node of the trie of all words by different children (the end of a word counts as one); the child with the most words is heavy,
the others are light, so at least one of the two is light there. At each node the light subtrees are merged with one character
skipped or replaced, and a word is light at no more than log2(words) nodes, so the merged trees have few terminals. A
light word x = P a S at node P (heavy child h) has these terminals, keys of one shuffle:

* P * S, a replaced: light words that coincide there are near each other (as many as there are letters, at most);
* P h S, P S (where S doesn't begin with a) and P h a S: words that coincide with a terminal of the trie itself are near x.

Each pair is found once: two words of equal length at the node where they part, a word and the longer one at the last
place of the run of equal letters that the skipped one belongs to. Children are counted by hashes of prefixes, so long words cost their length once;
a collision of hashes could make another child heavy, but takes and adds no pair, as pairs are met by whole keys.

The form of a word is its near word of largest n (ties: the smallest in code-point order), if that is ``dominance`` (2)
times its own or more; roots are found by doubling the chains of forms, which are at most log2(n) long.

Null text has no words; a null doc_id writes as nothing in ``<doc_id>:<run>``. Repeated rows count again. Very long texts and
words are taken whole. Only id and text are read, so no other column can clash. An empty table gives no rows.

Hot keys: prefixes of up to ``SHALLOW`` letters are met by broadcast (at most 91 + 91^2 nodes for these letters); all other keys
are words or their neighbours, or prefixes whose rows adaptive execution splits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, stored, table
from .packed import _odd, tidy

SHORTEST, LEAST, DOMINANCE, DELETE = 5, 3, 2, 97
APART = "[^a-zÀ-ÿ]+"
SHALLOW = 2
END = -1  # the end of a word, as a child


def occurrences(batches: Iterator[pa.RecordBatch], shortest: int, delete: int) -> Iterator[pa.RecordBatch]:
    """``word, n`` of each batch of ``doc_id, text``, with the code points deleted that the checksum of id and run names."""
    for b in batches:
        lists = pc.split_pattern_regex(pc.ascii_lower(b.column("text")), APART)
        flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy()
        doc = np.repeat(np.arange(len(n)), n)
        long = pc.greater_equal(pc.utf8_length(flat), shortest).to_numpy(zero_copy_only=False)
        d = flat.filter(pa.array(long)).dictionary_encode()
        pair, count = np.unique(doc[long] * max(1, len(d.dictionary)) + d.indices.to_numpy(), return_counts=True)
        doc, code = np.divmod(pair, max(1, len(d.dictionary)))
        runs = d.dictionary.to_pylist()
        raw = [x.encode() for x in runs]
        heads = [zlib.crc32(f"{x}:".encode()) for x in pc.fill_null(b.column("doc_id"), "").to_pylist()]
        h = np.fromiter((zlib.crc32(raw[c], heads[k]) for k, c in zip(doc.tolist(), code.tolist())), np.int64, len(pair))
        bad = h % delete == 0
        total = np.bincount(code[~bad], count[~bad], minlength=len(runs)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([d.dictionary.take(pa.array(some)), pa.array(total[some])], ["word", "n"])
        edited = [(w[:i] + w[i + 1 :], k) for w, i, k in ((runs[c], int(x) % len(runs[c]), int(k)) for c, x, k in zip(code[bad], h[bad], count[bad])) if len(w) > shortest]
        if edited:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in edited]), pa.array([k for _, k in edited], pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, delete: int = DELETE) -> DataFrame:
    """``word, n`` of the words that occur ``least`` times or more."""
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(tidy(lambda it: occurrences(it, shortest, delete)), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, child, depth, id`` along the path of every word of ``id, word``: a hash of the prefix, and the next code point."""
    by = np.zeros(0, np.uint64)
    for b in batches:
        words = b.column("word")
        n = pc.utf8_length(words).to_numpy().astype(np.int64)
        cp = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        rows = n + 1
        row = np.repeat(np.arange(len(n)), rows)
        first = np.cumsum(rows) - rows
        depth = np.arange(len(row)) - first[row]
        child = np.full(len(row), END, np.int64)
        inner = depth < n[row]
        child[inner] = cp
        if len(by) <= depth.max(initial=0):
            by = np.array(_odd(2 * int(depth.max(initial=0)) + 64), np.uint64)
        term = np.where(inner, (child + 1).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) * by[depth], np.uint64(0))
        before = np.cumsum(term) - term
        node = before - before[first][row] + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        node = (node ^ (node >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        node ^= node >> np.uint64(29)
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(child.astype(np.int32)), pa.array(depth.astype(np.int32)), b.column("id").take(pa.array(row))], ["node", "child", "depth", "id"])


def lights(words: DataFrame) -> DataFrame:
    """``id, depth, heavy`` for every node at which a word of ``words(id, word)`` is light, ``heavy`` its heavy child."""
    path = words.select("id", "word").mapInArrow(children, "node long, child int, depth int, id long")
    sizes = path.groupBy("node", "depth", "child").agg(F.count("*").alias("n"))
    order = F.struct(F.when(F.col("child") == END, F.lit(0)).otherwise(F.col("n")), -F.col("child"))
    heavy = stored(sizes.groupBy("node", "depth").agg(F.max_by("child", order).alias("heavy"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds"), "spelling-heavy")
    shallow, key = F.col("depth") <= SHALLOW, ["node", "depth"]
    top = path.where(shallow).join(F.broadcast(heavy.where(shallow)), key)
    rest = path.where(~shallow).join(heavy.where(~shallow), key)
    return top.unionByName(rest).where("child <> heavy").select("id", "depth", F.expr("chr(heavy)").alias("heavy"))


def near(words: DataFrame) -> DataFrame:
    """``a, b``: each pair of near words of ``words(id, word)``, once."""
    at = words.join(lights(words), "id").select("word", "heavy", F.substring("word", F.lit(1), F.col("depth")).alias("p"), F.substring("word", F.col("depth") + 1, F.lit(1)).alias("c"), F.expr("substring(word, depth + 2)").alias("s"))
    at = at.select("word", "c", F.concat("p", F.lit("*"), "s").alias("any"), F.array(F.concat("p", "heavy", "c", "s"), F.when(F.col("c") != "", F.concat("p", "heavy", "s")), F.when((F.col("c") != "") & ~F.col("s").startswith(F.col("c")), F.concat("p", "s"))).alias("to"))
    whole = at.select(F.col("word").alias("a"), F.explode("to").alias("b")).where("b is not null").join(words.select(F.col("word").alias("b")), "b").select("a", "b")
    group = at.where("c <> ''").groupBy("any").agg(F.sort_array(F.collect_list("word")).alias("w")).where("size(w) > 1")  # one a letter, at most
    both = group.select(F.posexplode("w").alias("i", "a"), "w").select("a", F.explode(F.expr("slice(w, i + 2, size(w))")).alias("b"))
    return whole.unionByName(both)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words of ``forms(word, form)``: the end of each chain, found by doubling it."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def variants(words: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words(word, n)``, whose words differ."""
    every = stored(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    pairs = stored(near(every), "spelling-pairs")
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = ways.join(every.select(F.col("word").alias("b"), "n"), "b")
    best = known.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "b")).alias("x")).select(F.col("a").alias("word"), "n_near", F.col("x.b").alias("best"), (-F.col("x.m")).alias("m"))
    rows = every.join(best, "word", "left").withColumn("own", F.col("m") >= dominance * F.col("n"))
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("own"), F.col("best")).alias("form"), F.when(F.col("own"), F.col("m")).alias("form_n")), "spelling-forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of the words of all whole documents."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))


#: DuckDB has no checksum of this kind: its table and its steps are spelt out. Near words by deleting each code point.
ORACLE = f"""
WITH RECURSIVE tab AS (SELECT [list_reduce([i] || range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all(t, '[a-zÀ-ÿ]+')) AS w FROM d) WHERE length(w) >= {SHORTEST} GROUP BY ALL),
b AS (SELECT w, n, hex(encode(concat(k, ':', w))) AS h FROM o),
c AS (SELECT w, n, xor(list_reduce([4294967295] || [CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS BIGINT) FOR i IN range(length(h) // 2)], lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) AS h FROM b, tab),
e AS (SELECT CASE WHEN h % {DELETE} = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS w, n FROM c),
words AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(w) >= {SHORTEST} GROUP BY w HAVING sum(n) >= {LEAST}),
v AS (SELECT w, i, concat(substr(w, 1, i - 1), substr(w, i + 1)) AS x FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words)),
near AS (SELECT v.w AS a, y.w AS b FROM v JOIN words y ON y.w = v.x UNION SELECT y.w, v.w FROM v JOIN words y ON y.w = v.x UNION SELECT p.w, q.w FROM v p JOIN v q ON p.i = q.i AND p.x = q.x AND p.w <> q.w),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS m FROM near JOIN words ON words.w = b GROUP BY a),
forms AS (SELECT words.w AS word, CASE WHEN m >= {DOMINANCE} * n THEN b END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {DOMINANCE} * n THEN m END AS form_n FROM words LEFT JOIN best ON a = words.w),
chain AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM forms UNION ALL SELECT chain.word, coalesce(f.form, chain.root), f.form IS NULL FROM chain JOIN forms f ON f.word = chain.root WHERE NOT done)
SELECT forms.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN chain ON chain.word = forms.word AND done
"""
