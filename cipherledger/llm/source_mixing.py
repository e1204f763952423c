"""Operator 7. Mixing sources to target weights by iterative proportional fitting.

Documents carry tokens in cells (source, language, topic). Raking multiplies the cells by one factor per source, one per
language and one per topic until the weighted token shares meet the target shares of all three margins. A document can't
be kept more than once, so the chances of the draw are raked too, bounded by 1 (``bounded``): the expected kept tokens are
``rate`` of all, or the largest part below at which no value of a margin needs more tokens than it has, and their shares
meet the targets unless cells that are at 1 rule it out together. Values with a target share below ``SMALL`` don't lower the rate; they are kept whole where they have too
few tokens. Margins missed by over ``MISSED`` are logged as warnings. The draw is a hash of the document's id and text, so a rerun or a lost executor changes nothing.

Targets default to shares tempered by a power of ``temper`` for sources, languages and topics each (a third of all rows in
one source then weigh less), and may be given as ``{value: share}``; values without a target share get 0, null is the
value ''. The cell sums are one grouped aggregation over all documents with partial sums before the shuffle; the cells,
sources x languages x topics at most, are raked on the driver while there are up to ``MAX_CELLS`` of them, and as a
DataFrame with the same arithmetic beyond.

``documents`` has no topic, so ``with_topic`` gives each whole text the nearest of ``TOPICS`` centres of hashed character
trigrams. The centres are fitted by weighted k-means on the exact sums of all rows' vectors by cell (``fit_topics``); every row is
counted and assigned. Texts
without a trigram, and null and empty texts, are topic -1 and have their own cell; they hold no tokens. Very long texts are
read whole, a million bytes at a time. Rows with the same doc_id and text share their draw. New columns whose names the
rows have get longer names; an empty table gives no rows.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import clear_name, cut, stored, table

TOPICS = 8
DIMS = 1024
SCALE = 1 << 24  # sums of 10 ** 11 vectors fit 64 bits
PLANES = 8
MERGERS = 16
ROUNDS = 100
MAX_CELLS = 200_000
TEMPER = 0.7
RATE = 0.8
MARGINS = ("source", "lang", "topic")
STEPS = 200
CLOSE = 1e-9
SMALL = 1e-3
MISSED = 1e-3

log = logging.getLogger(__name__)


def trigram_vector(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """Square roots of the shares of hashed byte trigrams of the lower-cased whole text; None if there is none."""
    b = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if len(b) < 3:
        return None
    out = np.zeros(dims, np.int64)
    for at in range(0, len(b) - 2, 1 << 20):
        x = b[at : at + (1 << 20) + 2].astype(np.uint32)
        h = (x[:-2] * np.uint32(2654435761) + x[1:-1] * np.uint32(40503) + x[2:] * np.uint32(2246822519)) >> np.uint32(16)
        out += np.bincount(h & np.uint32(dims - 1), minlength=dims)
    return np.sqrt(out / out.sum())


def _summed(docs: DataFrame, text: str, split: tuple[np.ndarray, np.ndarray] | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """``{cell: (rows, sum of their vectors)}`` over every text: cell 0 alone, or by the side of each plane of ``split = (mean,
    planes)`` on which a vector lies. Sums are of integers (``SCALE``), so no order of adding changes them; a task holds one sum a
    cell, and as many reach the driver."""
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(split)
    shape = "cell int, n long, v binary"

    def told(held):
        rows = sorted(held.items())
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([n for _, (n, _) in rows], pa.int64()), pa.array([v.tobytes() for _, (_, v) in rows], pa.binary())], ["cell", "n", "v"])

    def add(held, cell, n, v):
        m, have = held.get(cell, (0, None))
        held[cell] = (m + n, v if have is None else np.add(have, v, out=have))

    def run(batches):
        held: dict = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                if (v := trigram_vector(t)) is not None:
                    cell = 0
                    if known.value is not None:
                        mean, planes = known.value
                        cell = int(((planes @ (v - mean)) > 0) @ (1 << np.arange(len(planes))))
                    add(held, cell, 1, np.rint(v * SCALE).astype(np.int64))
        yield told(held)

    def merge(batches):
        held: dict = {}
        for b in batches:
            for cell, n, v in zip(*(c.to_pylist() for c in b.columns)):
                add(held, cell, n, np.frombuffer(v, np.int64).copy())
        yield told(held)

    rows = docs.select(F.col(text).cast("string").alias("text")).where("length(text) > 0")
    parts = rows.mapInArrow(run, shape).repartition(MERGERS, "cell").mapInArrow(merge, shape)
    return {r.cell: (r.n, np.frombuffer(bytes(r.v), np.int64) / SCALE) for r in parts.collect()}


def fit_topics(docs: DataFrame, topics: int = TOPICS, text: str = "text", seed: int = 5) -> np.ndarray:
    """K-means centres of all texts, each row counted once. The first pass sums all vectors, the second sums them by cell: ``PLANES``
    planes through the mean make 2 ** PLANES cells. The cells' means, weighted by their rows, are clustered on the driver, from
    the heaviest one and then those that lie farthest by weight."""
    whole = _summed(docs, text)
    if not whole:
        return np.zeros((0, DIMS))
    n, v = whole[0]
    planes = np.random.default_rng(seed).choice([-1.0, 1.0], (PLANES, DIMS))
    cells = [x for _, x in sorted(_summed(docs, text, (v / n, planes)).items())]
    w, x = np.array([n for n, _ in cells], float), np.array([v / n for n, v in cells])
    c = x[[w.argmax()]]
    while len(c) < min(topics, len(x)):
        far = w * ((x[:, None] - c[None]) ** 2).sum(2).min(1)
        if far.max() <= 0:
            break
        c = np.vstack([c, x[far.argmax()]])
    for _ in range(ROUNDS):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        new = np.array([np.average(x[near == j], 0, w[near == j]) if (near == j).any() else c[j] for j in range(len(c))])
        if np.abs(new - c).max() < 1e-12:
            break
        c = new
    return c


def with_topic(docs: DataFrame, centres: np.ndarray, text: str = "text", topic: str = "topic") -> DataFrame:
    """``docs`` with the topic of the whole text (int, -1 for none). A narrow step."""
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(centres)  # topics x dims

    @F.pandas_udf("int")
    def run(texts):
        import pandas as pd

        c, out = known.value, []
        half = (c * c).sum(1) / 2
        for t in texts:
            v = trigram_vector(t if isinstance(t, str) else None)
            out.append(-1 if v is None or not len(c) else int((c @ v - half).argmax()))
        return pd.Series(out, dtype="int32")

    return docs.withColumn(topic, run(F.col(text).cast("string")))


def tempered(mass: dict, power: float = TEMPER) -> dict:
    total = sum(m**power for m in mass.values() if m > 0)
    return {k: (m**power / total if m > 0 else 0.0) for k, m in mass.items()}


def rake(cells: list[tuple], targets: list[dict], steps: int = STEPS) -> np.ndarray:
    """Weights of ``cells (a, b, c, tokens)`` whose weighted token shares meet ``targets``; mean weight 1 by tokens."""
    n = np.array([c[-1] for c in cells], float)
    codes, goals = [], []
    for m, t in enumerate(targets):
        names = sorted({c[m] for c in cells}, key=str)
        at = {v: i for i, v in enumerate(names)}
        codes.append(np.array([at[c[m]] for c in cells]))
        g = np.array([max(0.0, t.get(v, 0.0)) for v in names])
        goals.append(g / g.sum() if g.sum() else g)
    w = n / n.sum()
    for _ in range(steps):
        off = 0.0
        for code, goal in zip(codes, goals):
            have = np.bincount(code, w, len(goal))
            factor = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            off = max(off, float(np.abs(have - goal).max()))
            w *= factor[code]
        if off < CLOSE:
            break
    total = w.sum()
    return np.divide(w / total if total else w, n / n.sum(), out=np.zeros_like(w), where=n > 0)


def chances(weights: np.ndarray, tokens: np.ndarray, rate: float) -> np.ndarray:
    """``min(1, keep * weight)`` with the constant that makes the expected kept tokens ``rate`` of all, if any can."""
    p, free = np.zeros(len(weights)), weights > 0
    left = rate * tokens.sum()
    for _ in range(len(weights) + 1):
        base = float((weights * tokens)[free].sum())
        if base <= 0:
            break
        keep = max(0.0, left) / base
        full = free & (weights * keep >= 1)
        if not full.any():
            p[free] = weights[free] * keep
            break
        p[full] = 1
        left -= float(tokens[full].sum())
        free &= ~full
    return p


def bounded(cells: list[tuple], weights: np.ndarray, targets: list[dict], rate: float, steps: int = STEPS) -> np.ndarray:
    """Chances of ``cells (a, b, c, tokens)``, 1 at most, whose expected kept tokens meet the shares of ``targets``."""
    n = np.array([c[-1] for c in cells], float)
    whole, codes, goals, masses = n.sum(), [], [], []
    for m, t in enumerate(targets):
        names = sorted({c[m] for c in cells}, key=str)
        at = {v: i for i, v in enumerate(names)}
        codes.append(np.array([at[c[m]] for c in cells]))
        g = np.array([max(0.0, t.get(v, 0.0)) for v in names])
        goals.append(g / g.sum() if g.sum() else g)
        masses.append(np.bincount(codes[-1], n, len(names)))
        rate = min([rate, *(masses[-1] / whole)[goals[-1] >= SMALL] / goals[-1][goals[-1] >= SMALL]]) if whole else rate
    shares = goals
    goals = []
    for g, mass in zip(shares, masses):
        g, few = rate * whole * g, rate * whole * g > mass
        free = g[~few].sum()
        goals.append(np.where(few, mass, g * ((g.sum() - mass[few].sum()) / free if free else 0)))
    p = np.minimum(1, rate * weights)
    for _ in range(steps):
        off = 0.0
        for code, goal in zip(codes, goals):
            have = np.bincount(code, p * n, len(goal))
            off = max(off, float(np.abs(have - goal).max()))
            p = np.minimum(1, p * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[code])
        if off <= CLOSE * whole:
            break
    missed = [int((np.abs(np.bincount(code, p * n, len(goal)) - goal) > MISSED * rate * whole).sum()) for code, goal in zip(codes, goals)]
    if any(missed):
        log.warning("mixing: %s values of %s miss their target shares by over %g", missed, MARGINS, MISSED)
    return p


def _bounded_wide(cells: DataFrame, goals: dict[str, DataFrame], rate: float, steps: int) -> DataFrame:
    """The same chances with the cells (``weight`` and ``n``) as a DataFrame."""
    whole = float(cells.agg(F.sum("n")).first()[0] or 0)
    held = {}
    for m in MARGINS:
        mass = cells.groupBy(m).agg(F.sum("n").cast("double").alias("mass"))
        held[m] = cut(mass.join(goals[m], m))
        least = held[m].where(F.col("goal") >= SMALL).agg(F.min(F.col("mass") / F.lit(whole) / F.col("goal"))).first()[0]
        rate = min(rate, least) if least is not None else rate
    tokens = {}
    for m in MARGINS:
        g = held[m].withColumn("goal", F.lit(rate * whole) * F.col("goal"))
        few = F.col("goal") > F.col("mass")
        x = g.agg(F.sum("goal"), F.sum(F.when(few, F.col("mass")).otherwise(0.0)), F.sum(F.when(few, 0.0).otherwise(F.col("goal")))).first()
        tokens[m] = cut(g.select(m, F.when(few, F.col("mass")).otherwise(F.col("goal") * F.lit((x[0] - x[1]) / x[2] if x[2] else 0.0)).alias("goal")))
    p = cut(cells.withColumn("chance", F.least(F.lit(1.0), F.lit(rate) * F.col("weight"))))
    have = lambda m, p: p.groupBy(m).agg(F.sum(F.col("chance") * F.col("n")).alias("have")).join(tokens[m], m)
    for _ in range(steps):
        off = 0.0
        for m in MARGINS:
            now = cut(have(m, p))
            off = max(off, now.agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0] or 0.0)
            factor = now.select(m, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("f"))
            p = cut(p.join(factor, m).withColumn("chance", F.least(F.lit(1.0), F.col("chance") * F.col("f"))).drop("f"))
        if off <= CLOSE * whole:
            break
    missed = [have(m, p).where(F.abs(F.col("have") - F.col("goal")) > MISSED * rate * whole).count() for m in MARGINS]
    if any(missed):
        log.warning("mixing: %s values of %s miss their target shares by over %g", missed, MARGINS, MISSED)
    return p


def _rake_wide(cells: DataFrame, targets: dict[str, dict] | None, temper: float, steps: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The same raking with the cells as a DataFrame, for cells beyond the driver's bound: each step is one grouped sum
    and one join a margin, checkpointed. Also the target shares of each margin: those of its values, 0 at least and
    summing to 1, as on the driver."""
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    w = cut(cells.withColumn("w", F.col("n") / F.lit(total) if total else F.lit(0.0)))
    goals = {}
    for m in MARGINS:
        mass = cells.groupBy(m).agg(F.sum("n").cast("double").alias("mass"))
        if targets and targets.get(m):
            t = targets[m]
            given = cells.sparkSession.createDataFrame([(str(k), max(0.0, float(v))) for k, v in t.items()], f"{m} string, goal double")
            raw = mass.join(given, m, "left").select(m, F.coalesce("goal", F.lit(0.0)).alias("goal"))
        else:
            raw = mass.select(m, F.when(F.col("mass") > 0, F.pow("mass", F.lit(temper))).otherwise(0.0).alias("goal"))
        whole = float(raw.agg(F.sum("goal")).first()[0] or 0)
        goals[m] = cut(raw.withColumn("goal", F.col("goal") / F.lit(whole or 1.0)))
    for _ in range(steps):
        off = 0.0
        for m in MARGINS:
            now = cut(w.groupBy(m).agg(F.sum("w").alias("have")).join(goals[m], m))
            off = max(off, now.agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0] or 0.0)
            factor = now.select(m, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("f"))
            w = cut(w.join(factor, m).withColumn("w", F.col("w") * F.col("f")).drop("f"))
        if off < CLOSE:
            break
    sums = w.agg(F.sum("w"), F.sum("n")).first()
    return w.withColumn("weight", F.when(F.col("n") > 0, F.col("w") / F.lit(sums[0] or 1.0) / (F.col("n") / F.lit(sums[1]))).otherwise(0.0)).drop("w"), goals


def told(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the topic, the words and the draw of each whole text, and what these columns are called: the only step
    that reads texts."""
    names = {c: clear_name(docs, c) for c in ("topic", "n_tokens", "weight", "chance", "kept", "draw")}
    words = F.coalesce(F.size(F.split(F.trim(F.col(text)), r"\s+")), F.lit(0)).cast("bigint")
    words = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", F.lit(0).cast("bigint")).otherwise(words)
    draw = F.xxhash64(F.lit("mix"), F.col(doc_id), F.col(text)) / F.lit(2.0**64) + F.lit(0.5)
    out = with_topic(docs, fit_topics(docs, text=text), text, names["topic"])
    return out.withColumn(names["n_tokens"], words).withColumn(names["draw"], draw), names


def mixed(docs: DataFrame, targets: dict[str, dict] | None = None, rate: float = RATE, temper: float = TEMPER, max_cells: int = MAX_CELLS, steps: int = STEPS, text: str = "text", doc_id: str = "doc_id", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_tokens`` (words), ``topic``, ``weight``, ``chance`` and ``kept`` (the draw). ``docs`` needs the columns
    source and lang; targets are given by margin as strings. Texts are read once: what they tell is written to the shared
    folder beside the other columns but those to ``drop``."""
    spark = docs.sparkSession
    rows, names = told(docs, text, doc_id)
    columns = [c for c in docs.columns if c not in drop]
    rows = stored(rows.select(*columns, *(names[c] for c in ("n_tokens", "topic", "draw"))), "mixing")
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")]
    cells = cut(rows.select(*key, F.col(names["topic"]).cast("string").alias("topic"), F.col(names["n_tokens"]).alias("n")).groupBy(*MARGINS).agg(F.sum("n").alias("n")))
    if cells.count() <= max_cells:
        held = sorted(tuple(r) for r in cells.collect())
        goals = [(targets or {}).get(m) or tempered(_mass(held, i), temper) for i, m in enumerate(MARGINS)]
        w = rake(held, goals, steps) if held else np.zeros(0)
        p = bounded(held, w, goals, rate, steps) if held else np.zeros(0)
        plan = spark.createDataFrame([(*r[:3], float(a), float(b)) for r, a, b in zip(held, w, p)], "c_source string, c_lang string, c_topic string, c_weight double, c_chance double")
        plan = F.broadcast(plan) if len(held) <= 20_000 else plan
    else:
        wide, shares = _rake_wide(cells, targets, temper, steps)
        wide = _bounded_wide(cut(wide), shares, rate, steps)
        plan = wide.select(*(F.col(c).alias(f"c_{c}") for c in MARGINS), F.col("weight").alias("c_weight"), F.col("chance").alias("c_chance"))
    own = {c: clear_name(rows, c) for c in plan.columns}
    plan = plan.select(*(F.col(a).alias(b) for a, b in own.items()))
    here = [*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang")), F.col(names["topic"]).cast("string")]
    same = [k == F.col(own[f"c_{m}"]) for k, m in zip(here, MARGINS)]
    weight, chance = F.col(own["c_weight"]), F.col(own["c_chance"])
    out = rows.join(plan, same[0] & same[1] & same[2], "left")
    return out.select(*columns, names["n_tokens"], names["topic"], weight.alias(names["weight"]), chance.alias(names["chance"]), F.coalesce(F.col(names["draw"]) < chance, F.lit(False)).alias(names["kept"]))


def _mass(rows: list[tuple], margin: int) -> dict:
    out: dict = {}
    for r in rows:
        out[r[margin]] = out.get(r[margin], 0) + r[-1]
    return out


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, chance and draw of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs, drop=("text",)).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "chance", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the draw keeps stay. Null and empty texts hold no tokens and have their own cells, rows of one id and
    text are drawn alike, a null source or language is the value ''; other columns are kept. An empty table stays empty."""
    out = mixed(docs)
    new = [c for c in out.columns if c not in docs.columns]
    return out.where(F.col(new[-1])).select(*docs.columns)
