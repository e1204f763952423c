"""Operator 4. Toxicity by class-conditional Kneser-Ney models.

An expression is a word, spelt out between word marks. Two interpolated Kneser-Ney models of its characters (order
``ORDER``), one learnt from toxic and one from ordinary texts, discount their own counts and share every backoff
distribution: the lower orders are continuation counts pooled over both classes, so a rare spelling that neither class
has seen costs the same in both and only evidence moves the ratio. A word's weight is its toxic minus its ordinary log
likelihood.

A whole text is scored by length-normalised weights: their mean over all its words, the highest means over sliding
windows of ``WINDOWS`` words and over its most telling words (see ``features``). A logistic fit on out-of-fold weights of the training rows (two folds) turns these into a
probability. Texts without words get the score of zero evidence.

An n-gram's log ratio of both models is known once it is learnt, and an unseen n-gram behind a seen context gets the
ratio of the two backoff weights (the shared distribution below cancels), so a model is two packed tables: 64-bit keys of
n-grams with their ratios, and of contexts with theirs. Counts, continuation counts and probabilities of all orders are
grouped sums and joins on the executors; the driver meets the packed tables alone, 12 bytes an n-gram, and a worker
holds them for the time of a task. Two of 10^8 n-grams share a key with a chance below 0.001.

The n-gram counts are those of all labelled rows, so the models grow with the input's different n-grams. Only the
logistic fit takes a sample, at most ``MAX_TOXIC`` toxic and ``MAX_ORDINARY`` ordinary rows, those with the smallest hashes
of doc_id (then of text); its intercept is corrected to the class shares of all labelled rows, so the threshold means the
same at every size.

Odd input: null and empty texts, and texts without a letter, have the score of zero evidence. Very long texts and runs of
letters are read whole. A spelling counts once a text; repeated rows count as often as they occur and get equal scores.
Null labels are no labels; a doc_id with several labels is toxic if one of them is 1; null doc_ids have none. Without a
text of each class, as on empty tables, every score is 0. A score's name that the rows have in any case is lengthened.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .common import clear_name, cut, stored, table
from .packed import code_points, find, in_parts, keys_of, tidy

ORDER = 6
MAX_TOXIC = 3_000
MAX_ORDINARY = 6_000
WINDOWS = (8, 64)
TOPS = (1, 3, 6, 12)
STRONG = 2.5
THRESHOLD = 0.7
DISCOUNT = 0.75
CACHE = 150_000
SPELT = 40_000
BROADCAST = 2_000_000  # labelled ids, 12 bytes each
LONG = 40
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(w: str, order: int = ORDER) -> list[str]:
    """The n-grams of a word between its marks."""
    s = "^" * (order - 1) + w + "$"
    return [s[i : i + order] for i in range(len(s) - order + 1)]


class Model:
    """Log ratios of toxic to ordinary probabilities: of learnt n-grams, and of learnt contexts before an unseen letter.
    Both tables are sorted by key."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], order: int = ORDER):
        self.known, self.contexts, self.order = known, contexts, order

    @property
    def top(self) -> tuple[bytes, ...]:
        return tuple(x.tobytes() for x in (*self.known, *self.contexts))

    def weights(self, found: list[str]) -> np.ndarray:
        """The log ratio of each word: the sum over its n-grams."""
        if not found:
            return np.zeros(0)
        n, mark = self.order, "^" * (self.order - 1)
        cp = code_points("".join([f"{mark}{w}$" for w in found]))
        size = np.fromiter(map(len, found), np.int64, len(found)) + 1
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.arange(int(size.sum())) + np.repeat(np.arange(len(found)) * (n - 1), size)
        ratios, hit = find(*self.known, keys_of(cp, n)[at])
        if not hit.all():
            ratios[~hit] = find(*self.contexts, keys_of(cp, n - 1)[at[~hit]])[0]
        return np.add.reduceat(ratios, first)

    def weight(self, w: str) -> float:
        return float(self.weights([w])[0])


def features(found: list[str], weights: np.ndarray) -> list[float]:
    """Length-normalised evidence of a text: the mean weight, the highest mean of each window (shorter texts: of the whole
    text), the means of the highest weights of different words, the weight above ``STRONG`` a word, and the length."""
    if not len(weights):
        return [0.0] * (len(WINDOWS) + len(TOPS) + 4)
    total = np.concatenate([[0.0], np.cumsum(weights)])
    out = [total[-1] / len(weights)]
    for w in WINDOWS:
        w = min(w, len(weights))
        out.append(float((total[w:] - total[:-w]).max()) / w)
    each = np.sort(np.array([*dict(zip(found, weights.tolist())).values()]))[::-1]
    out += [float(each[:k].sum()) / k for k in TOPS]
    strong = np.maximum(each - STRONG, 0).sum()
    return [*out, float(strong), 100 * float(strong) / len(weights), math.log1p(len(weights))]


class Scorer:
    def __init__(self, model: Model | None, fit: np.ndarray | None):
        self.model, self.fit, self.seen = model, fit, {}

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def features_all(self, texts: list[str | None]) -> Iterator[list[float]]:
        """The features of each text. The new words of a part of the texts are weighed in one go."""
        for part in in_parts(texts):
            split = [words(t) for t in part]
            if len(self.seen) > CACHE:
                self.seen = {}
            new = list(set().union(*split).difference(self.seen))
            seen = self.seen
            seen.update(zip(new, self.model.weights(new).tolist()))
            for found in split:
                yield features(found, np.array([seen[w] for w in found]))
            for w in new:
                if len(w) > LONG:  # scored whole, not remembered
                    del seen[w]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None or not texts:
            return np.zeros(len(texts))
        z = _scaled(np.array(list(self.features_all(texts)))) @ self.fit
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _scaled(x) -> np.ndarray:
    """A constant and the features with their tails pressed together."""
    x = np.atleast_2d(np.asarray(x, float))
    return np.concatenate([np.ones((len(x), 1)), np.sign(x) * np.log1p(np.abs(x))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton's method, classes weighed as they come."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(y) * np.r_[0, w[1:]]
        h = (x.T * (p * (1 - p) + 1e-9)) @ x + ridge * len(y) * np.diag(np.r_[0, np.ones(len(w) - 1)])
        step = np.linalg.solve(h + 1e-9 * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def spellings(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``g, toxic, fold, n``: how many ``rows(text, toxic, fold)`` of a class and fold spell the n-gram g, once for each
    different word that does; the empty g counts the rows themselves."""

    @tidy
    def spelt(batches):
        def sums():
            for (y, f), own in got.items():
                out: Counter = Counter()
                for w, n in own.items():
                    for g in grams(w, order):
                        out[g] += n
                out[""] = texts.pop((y, f), 0)
                k = len(out)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([y] * k, pa.int32()), pa.array([f] * k, pa.int32()), pa.array(list(out.values()), pa.int64())], ["g", "toxic", "fold", "n"])
            got.clear()

        got: dict[tuple, Counter] = {}
        texts: Counter = Counter()
        for b in batches:
            for t, y, f in zip(*(c.to_pylist() for c in b.columns)):
                texts[y, f] += 1
                got.setdefault((y, f), Counter()).update(set(words(t)))
                if sum(map(len, got.values())) > SPELT:
                    yield from sums()
        yield from sums()

    return rows.mapInArrow(spelt, "g string, toxic int, fold int, n long").groupBy("g", "toxic", "fold").agg(F.sum("n").alias("n"))


def ratios(sums: DataFrame, order: int = ORDER) -> DataFrame:
    """``m, context, s, v``: the log ratios of the n-grams and contexts of three models: m = 0 and 1 score the fold of that
    number and are learnt from the other one, 2 is learnt from both."""
    in_class = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0))
    models = F.explode(F.array(1 - F.col("fold"), F.lit(2))).alias("m")
    tail, head = F.expr("substring(s, 2)"), lambda n: F.expr(f"left(s, {n})")
    top = cut(sums.where("g <> ''").select(models, F.col("g").alias("s"), "toxic", "n").groupBy("m", "s").agg(in_class(1).alias("t"), in_class(0).alias("o")))
    low = [top]
    for _ in range(order - 1):  # distinct longer n-grams behind each shorter one, those of both classes
        low.append(low[-1].select("m", tail.alias("s")).groupBy("m", "s").agg(F.count("*").alias("x")))
        low[-1] = cut(low[-1])
    d, below = F.lit(DISCOUNT), None
    for n in range(1, order):
        w = Window.partitionBy("m", head(n - 1)) if n > 1 else Window.partitionBy("m")  # as many rows as letters, at most
        at = low[order - n].select("m", "s", "x", F.sum("x").over(w).alias("total"), F.count("*").over(w).alias("kinds"))
        if below is None:
            at = at.withColumn("p", 1 / F.greatest(F.lit(2), F.col("kinds") + 1))
        else:
            at = at.withColumn("b", tail).join(below, ["m", "b"])
        p = (F.greatest(F.col("x") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("p")) / F.col("total")
        below = cut(at.select("m", F.col("s").alias("b"), p.alias("p")))
    w = Window.partitionBy("m", head(order - 1))
    sides = [x for c in "to" for x in (F.sum(c).over(w).alias(f"{c}_total"), F.sum((F.col(c) > 0).cast("int")).over(w).alias(f"{c}_kinds"))]
    both = cut(top.select("m", "s", "t", "o", *sides).withColumn("b", tail).join(below, ["m", "b"]))

    def p(c: str) -> Column:
        total = F.col(f"{c}_total")
        return F.when(total > 0, (F.greatest(F.col(c) - d, F.lit(0.0)) + d * F.col(f"{c}_kinds") * F.col("p")) / total).otherwise(F.col("p"))

    weight = lambda c: F.when(F.col(f"{c}_total") > 0, d * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0)
    known = both.select("m", F.lit(False).alias("context"), "s", F.log(p("t") / p("o")).alias("v"))
    contexts = both.select("m", F.lit(True).alias("context"), head(order - 1).alias("s"), F.log(weight("t") / weight("o")).alias("v")).dropDuplicates(["m", "s"])
    return known.union(contexts)


def packed(ratio: DataFrame) -> DataFrame:
    """``ratios`` with 64-bit keys in place of the strings."""

    def run(batches):
        for b in batches:
            strings = b.column(2).to_pylist()
            key = np.zeros(len(strings), np.uint64)
            for n in {len(x) for x in strings}:
                own = np.array([len(x) == n for x in strings])
                key[own] = keys_of(code_points("".join([x for x in strings if len(x) == n])), n)[::n]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key.view(np.int64)), b.column(3).cast(pa.float32())], ["m", "context", "key", "v"])

    return ratio.mapInArrow(run, "m int, context boolean, key long, v float")


def _model(tables: DataFrame, m: int, order: int) -> Model:
    def sorted_by_key(context: bool):
        got = tables.where((F.col("m") == m) & (F.col("context") == context)).select("key", "v").toArrow()
        key, v = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
        at = np.argsort(key)
        return key[at], v[at]

    return Model(sorted_by_key(False), sorted_by_key(True), order)


def fit(rows: DataFrame, sample: DataFrame, order: int = ORDER) -> Scorer:
    """A scorer from labelled ``rows(text, toxic, key)`` and the bounded ``sample`` of them for the logistic fit."""
    ship(rows.sparkSession)
    folded = lambda x: x.select("text", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "key"), F.lit(2)).cast("int").alias("fold"))
    rows, sample = folded(rows), cut(folded(sample))
    sums = cut(spellings(rows, order))
    texts = {r.toxic: r.n for r in sums.where("g = ''").groupBy("toxic").agg(F.sum("n").alias("n")).collect()}  # two rows
    spelt = {r.toxic for r in sums.where("g <> ''").select("toxic").distinct().collect()}
    if spelt != {0, 1}:
        return Scorer(None, None)
    tables = cut(packed(ratios(sums, order)))
    sc, seen = rows.sparkSession.sparkContext, []
    for f in (0, 1):  # one fold's model after the other: a worker holds one at a time
        half = sc.broadcast(Scorer(_model(tables, f, order), None))

        @tidy
        def felt(batches, half=half):
            scorer = half.value
            for b in batches:
                got = [(float(y), *x) for y, x in zip(b.column(1).to_pylist(), scorer.features_all(b.column(0).to_pylist()))]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64()))], ["x"])

        seen += [r.x for r in sample.where(F.col("fold") == f).select("text", "toxic").mapInArrow(felt, "x array<double>").collect()]
        half.destroy()
    seen = np.array(sorted(seen))
    w = logistic(_scaled(seen[:, 1:]), seen[:, 0])
    toxic = float(seen[:, 0].sum())
    if 0 < toxic < len(seen):  # from the sample's class shares to those of all rows
        w[0] += math.log(texts[1] / texts[0]) - math.log(toxic / (len(seen) - toxic))
    return Scorer(_model(tables, 2, order), w)


def train(docs: DataFrame, labels: DataFrame, use: Column, text: str = "text", max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> Scorer:
    """Fits on the labelled documents for which ``use``, a condition on ``key``, holds; the bounds are the logistic fit's."""
    y = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("key")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(use)
    y = cut(y.where("toxic in (0, 1)"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("th"))
    if y.count() <= BROADCAST:
        rows = rows.join(F.broadcast(y), "key")
    else:  # one shuffle of the texts, whatever is made of them
        rows = stored(rows.join(y, "key"), "labelled")
    marks = cut(rows.select("toxic", "key", "th").distinct())
    bounded = [marks.where(F.col("toxic") == c).orderBy(F.xxhash64("key"), "key", "th").limit(n) for c, n in ((1, max_toxic), (0, max_ordinary))]
    picked = F.broadcast(cut(bounded[0].union(bounded[1]).select("key", "th")))  # at most max_toxic + max_ordinary rows
    return fit(rows, rows.join(picked, ["key", "th"]).dropDuplicates(["key", "th"]))


def scored(docs: DataFrame, scorer: Scorer, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability ``score`` (0 to 1) that label 1 fits the whole text. A narrow step: no shuffle."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = known.value
        for texts in batches:
            yield pd.Series(s.scores([t if isinstance(t, str) else None for t in texts]), dtype=float)
        s.seen = {}

    return docs.withColumn(clear_name(docs, score), run(F.col(text).cast("string")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learnt from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    third = lambda c: F.pmod(F.crc32(F.col(c).cast("bigint").cast("string").cast("binary")), F.lit(3))
    scorer = train(docs, table(spark, sf_dir, "labels"), third("key") != 1)
    out = scored(docs.select("doc_id", "text"), scorer)
    return out.select("doc_id", F.coalesce(third("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored at the threshold or above go. Learns from all labels of ``sf_dir``. Null, empty and letterless texts
    stay, repeated rows get one answer, other columns are kept as they are; an empty table stays empty."""
    scorer = train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    s = clear_name(docs, "score")
    return scored(docs, scorer, score=s).where(F.col(s) < THRESHOLD).drop(s)
