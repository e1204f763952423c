"""Operator 3. Language identification by word-first backoff.

A word that the model knows is scored in every language by its log frequency there. A word that it doesn't know is
scored by its character n-grams, first of ``MAX_N`` characters; an n-gram that no language knows is replaced by its two
parts one character shorter, and so on down to single characters. Log frequencies are add-``ALPHA`` smoothed. A whole
text takes the language with the highest mean score over its words (runs of letters, lower-cased); ``score`` is that
language's share of the probability under these means, sharpened by ``SHARP`` words at most.

Counts are learnt from at most ``MAX_TEXTS`` whole labelled rows of each language (those with the smallest hashes of
doc_id, then of text), a documented bound, so every language with a labelled text is in the model at every size; words
seen in one text only are left to the n-grams. The model is packed: sorted 64-bit keys of words and n-grams and a matrix
of 32-bit log frequencies; a worker holds it for the time of a task.

Odd input: null text, and text without a letter, is ``und`` with score 0; with nothing to learn from (empty tables, no
label) every text is. Very long texts and runs of letters are read whole. Equal scores go to the language that comes
first in alphabetical order. Repeated rows get equal answers and are learnt from once. Null doc_ids and null labels
teach nothing. New columns whose names the rows have in any case get longer names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .common import clear_name, cut, table
from .packed import code_points, find, in_parts, keys_of, tidy

SALTS = 256
MAX_TEXTS = 2_000
MAX_N = 5
ALPHA = 0.5
SHARP = 50
CACHE = 150_000
COUNTED = 100_000
LONG = 40
WORD = re.compile(r"[^\W\d_]+")
UND = "und"


def _places(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words between their marks, where each begins, and its length with the marks."""
    size = np.fromiter(map(len, found), np.int64, len(found)) + 2
    return code_points("".join([f"^{w}$" for w in found])), np.cumsum(size) - size, size


def _starts(first: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the n-grams of the words begin, and the number of the word of each."""
    many = np.maximum(size - n + 1, 0)
    word = np.repeat(np.arange(len(size)), many)
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[word], word


def _word_keys(found: list[str]) -> np.ndarray:
    """Keys of whole words: the sum of the keys of their places, each with its letter's."""
    cp, first, size = _places(found)
    at = np.arange(len(cp)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        x = (cp.astype(np.uint64) + np.uint64(0x1F1F1F)) * (np.uint64(2) * at.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        return np.add.reduceat(x, first)


class Model:
    def __init__(self, langs: list[str], counts: dict[str, dict[str, int]], texts: dict[str, int]):
        """``counts[word][lang]`` and in how many texts a word was seen."""
        self.langs, at = langs, {x: i for i, x in enumerate(langs)}
        found = list(counts)
        n = np.zeros((len(found), len(langs)))
        for i, w in enumerate(found):
            for x, k in counts[w].items():
                n[i, at[x]] = k
        often = np.fromiter((texts[w] > 1 for w in found), bool, len(found))
        none = np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32)
        self.words = self._logs(_word_keys([w for w, o in zip(found, often) if o]), n[often]) if often.any() else none
        self.grams = [none] * (MAX_N + 1)
        if found:
            cp, first, size = _places(found)
            for k in range(1, MAX_N + 1):
                start, word = _starts(first, size, k)
                if len(start):
                    self.grams[k] = self._logs(keys_of(cp, k)[start], n[word])
        self.clear()

    def clear(self) -> None:
        self.rows, self.table = {}, None

    def __getstate__(self):
        return {**self.__dict__, "rows": {}, "table": None}

    @staticmethod
    def _logs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys and their smoothed log frequencies in each language."""
        some, back = np.unique(keys, return_inverse=True)
        x = np.stack([np.bincount(back, counts[:, j], len(some)) for j in range(counts.shape[1])], 1) + ALPHA
        return some, np.log(x / x.sum(0)).astype(np.float32)

    def word_scores(self, found: list[str]) -> np.ndarray:
        """The scores of each word in every language, less the best one: by the word, else by its n-grams."""
        out, known = find(*self.words, _word_keys(found))
        todo = np.flatnonzero(~known)
        if len(todo):
            cp, first, size = _places([found[i] for i in todo])
            total, parts = np.zeros((len(todo), len(self.langs))), np.zeros(len(todo))
            owner = np.repeat(np.arange(len(todo)), size)
            times = np.zeros((MAX_N + 1, len(cp) + 1))
            for n in {MAX_N, *range(3, MAX_N)}:  # words with marks have three characters or more
                own = size >= MAX_N if n == MAX_N else size == n
                times[n, _starts(first[own], size[own], n)[0]] = 1
            for n in range(MAX_N, 0, -1):
                at = np.flatnonzero(times[n])
                if not len(at):
                    continue
                score, hit = find(*self.grams[n], keys_of(cp, n)[at])
                k, w = times[n, at], owner[at]
                parts += np.bincount(w[hit], k[hit], len(todo))
                for j in range(len(self.langs)):
                    total[:, j] += np.bincount(w[hit], k[hit] * score[hit, j], len(todo))
                lost = at[~hit]
                if n > 1:  # an unknown n-gram counts as its two parts
                    times[n - 1, lost] += times[n, lost]
                    times[n - 1, lost + 1] += times[n, lost]
            out[todo] = total / np.maximum(parts, 1)[:, None]
        return out - out.max(1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float]:
        return next(self.predict_all([text]))

    def predict_all(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Language and score of each text. The new words of a part of the texts are scored in one go."""
        for part in in_parts(texts):
            split = [Counter(WORD.findall(t.lower())) if t and self.langs else None for t in part]
            every = list(set().union(*(c for c in split if c)))
            if self.table is None or len(self.rows) + len(every) > CACHE:
                self.rows, self.table = {}, np.zeros((CACHE, len(self.langs)), np.float32)
            get, rows = self.rows.get, self.rows
            have = np.fromiter((get(w, -1) for w in every), np.int64, len(every))
            scores = np.zeros((len(every), len(self.langs)))
            scores[have >= 0] = self.table[have[have >= 0]]
            new = np.flatnonzero(have < 0)
            if len(new):
                fresh = [every[i] for i in new]
                scores[new] = self.word_scores(fresh).astype(np.float32)
                for i, w in zip(new.tolist(), fresh):
                    if len(w) <= LONG and len(rows) < CACHE:  # longer ones are scored whole, not remembered
                        self.table[len(rows)] = scores[i]
                        rows[w] = len(rows)
            at = {w: i for i, w in enumerate(every)}
            for c in split:
                if not c:
                    yield UND, 0.0
                    continue
                times = np.fromiter(c.values(), float, len(c))
                n = times.sum()
                mean = times @ scores[[at[w] for w in c]] / n * min(n, SHARP)
                p = np.exp(mean - mean.max())
                best = int(p.argmax())
                yield self.langs[best], float(p[best] / p.sum())


def train(docs: DataFrame, use: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_texts: int = MAX_TEXTS) -> Model:
    """Counts the words of the bounded sample on the executors, once for each language, and builds the model from them."""
    ship(docs.sparkSession)
    t = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("key"), F.col(lang).cast("string").alias("lang"), F.xxhash64(t).alias("th"), t.alias("text")).where("lang is not null and key is not null").where(use)
    order = [F.xxhash64("key"), "key", "th"]
    top = lambda x, *by: x.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= max_texts).drop("r")
    # the first of each part of a language, then the first of those: no task takes all rows of a language
    salted = rows.select("key", "lang", "th").distinct().withColumn("salt", F.pmod(F.xxhash64("th", "key"), F.lit(SALTS)))
    marks = top(top(salted, "lang", "salt").drop("salt"), "lang")
    marks = F.broadcast(cut(marks))  # at most max_texts rows a language
    picked = cut(rows.join(marks, ["key", "lang", "th"]).dropDuplicates(["key", "lang", "th"]).select("lang", "text"))

    @tidy
    def count(batches):
        def sums():
            ks = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in ks], pa.string()) for i in range(2)] + [pa.array([n[k] for k in ks], pa.int64()), pa.array([seen[k] for k in ks], pa.int64())], ["w", "lang", "n", "t"])
            n.clear()
            seen.clear()

        n, seen = Counter(), Counter()
        for b in batches:
            for x, t in zip(*(c.to_pylist() for c in b.columns)):
                for w, k in Counter(WORD.findall(t.lower()) if t else ()).items():
                    n[w, x] += k
                    seen[w, x] += 1
                if len(n) > COUNTED:
                    yield from sums()
        yield from sums()

    sums = picked.mapInArrow(count, "w string, lang string, n long, t long").groupBy("w", "lang").agg(F.sum("n"), F.sum("t"))
    counts, texts = {}, Counter()
    for b in sums.toArrow().to_batches():
        for w, x, n, t in zip(*(c.to_pylist() for c in b.columns)):
            counts.setdefault(w, {})[x] = n
            texts[w] += t
    return Model(sorted({x for by in counts.values() for x in by}), counts, texts)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of the whole text. A narrow step: no shuffle."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = known.value
        for texts in batches:
            yield pd.DataFrame(list(m.predict_all([t if isinstance(t, str) else None for t in texts])), columns=["lang_pred", "score"])
        m.clear()

    got = clear_name(docs, "langid")
    out = docs.withColumn(got, run(F.col(text).cast("string")))
    return out.select(*docs.columns, *(F.col(f"{got}.{c}").alias(clear_name(docs, c)) for c in ("lang_pred", "score")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learnt from documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    quarter = lambda c: F.pmod(F.crc32(F.col(c).cast("bigint").cast("string").cast("binary")), F.lit(4))
    model = train(docs, quarter("key") != 2)
    return identified(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(quarter("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
