"""Operator 2. Exact top-k search by inner product over a pivot-distance index.

Integer vectors are lifted so that the highest inner product is the nearest point: a stored vector x gets one more
coordinate sqrt(M^2 - |x|^2), where M is the greatest norm of all, a query q gets 0, and |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.
The index keys every lifted vector by its nearest pivot (k-means centres of a bounded sample of ``SAMPLE`` vectors) and
its distance to it; each pivot's distances are cut into ``RINGS`` sorted annuli. A query first searches the annuli
nearest to it that together hold enough vectors, which gives a bound: the k-th score so far. It then expands to every
other annulus [a, b] of pivot p that the triangle inequality can't exclude, max(a - d(q,p), d(q,p) - b) <= the distance
of that score, and stops there. The result is exact.

Rows are what is searched: a query's own row is no candidate of it, all others are, also those with the same id or the
same vector. Equal vectors are stored once with the ids of their first k+1 rows, and equal queries are searched once for
k+1 rows; a query's own row is dropped after that, so copies cost nothing and lose nothing. Annuli larger than ``BLOCK``
vectors, or wanted by more than ``CHUNK`` queries, are dealt as a grid of blocks, so a task's matrices stay bounded.

Odd input: null vectors and vectors with null or non-finite components take no part; nor do null ids. Components become
floor(scale * x). Shorter vectors count as padded with zeros. Repeated query rows get an answer each; ties go to smaller
ids. Only the two columns named are read, so others can't clash. Empty tables, of queries or of candidates, give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .common import cut, table

SAMPLE = 4096
RINGS = 4
BLOCK = 8192
CHUNK = 2048
SCALE = 256


def quantised(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``id, vec``: floor(scale * x) of the valid vectors as little-endian 64-bit integers in a binary column."""
    ship(rows.sparkSession)
    own = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = own.where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")

    def run(batches):
        for b in batches:
            v = b.column(1)
            flat, off = v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            q = np.floor(scale * flat)
            if len(q) and np.abs(q).max() >= 2**62:
                raise ValueError("a component is too large for 64-bit scores")
            q, off = q.astype("<i8"), off - off[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([q[s:e].tobytes() for s, e in zip(off, off[1:])], pa.binary())], ["id", "vec"])

    return good.mapInArrow(run, "id bigint, vec binary")


def _matrix(vecs, dim: int) -> np.ndarray:
    out = np.zeros((len(vecs), dim))
    for i, v in enumerate(vecs):
        x = np.frombuffer(v, "<i8")
        out[i, : len(x)] = x
    return out


def _norms(vecs) -> np.ndarray:
    return np.array([float((np.frombuffer(v, "<i8").astype(float) ** 2).sum()) for v in vecs])


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0))


class Index:
    """Pivots, ring edges and the greatest squared norm; bounded by the sample."""

    def __init__(self, sample, dim: int, most: float, pivots: int, rings: int = RINGS):
        self.dim, self.most = dim, most
        x = self.lift(sample)
        self.pivots = _kmeans(x, min(pivots, len(x)))
        d = _distances(x, self.pivots)
        near = d.argmin(1)
        cut_at = np.arange(1, rings) / rings
        self.edges = np.array([np.quantile(d[near == j, j], cut_at) if (near == j).any() else np.full(rings - 1, np.inf) for j in range(len(self.pivots))])

    def lift(self, vecs, query: bool = False) -> np.ndarray:
        x = _matrix(vecs, self.dim)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))
        return np.concatenate([x, last[:, None]], 1)

    def place(self, vecs) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(self.lift(vecs), self.pivots)
        p = d.argmin(1)
        dist = d[np.arange(len(p)), p]
        ring = (dist[:, None] > self.edges[p]).sum(1)
        return (p * (self.edges.shape[1] + 1) + ring).astype(np.int32), dist


def _best(score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to smaller first ids (columns are sorted by them)."""
    if score.shape[1] <= k:
        return np.tile(np.arange(score.shape[1]), (len(score), 1))
    kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    above, at = score > kth[:, None], score == kth[:, None]
    left = k - above.sum(1)
    take = above | (at & (np.cumsum(at, 1) <= left[:, None]))
    return np.nonzero(take)[1].reshape(len(score), k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, pivots: int | None = None, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``query_id, rank, id, score``: for each row of ``queries(id, vec)`` the k rows of ``candidates(id, vec)`` with the highest
    integer inner products, ties to smaller ids; one row that equals the query's, its own, is left out. Both as
    ``quantised`` gives them."""
    spark, want = candidates.sparkSession, k + 1
    ship(spark)
    w = Window.partitionBy("vec").orderBy("id")
    stored = candidates.withColumn("r", F.row_number().over(w)).where(F.col("r") <= want).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    stored = cut(stored)
    asked = cut(queries.groupBy("id", "vec").agg(F.count("*").alias("times")))
    wanted = asked.select("vec").distinct()

    def stats(batches):
        for b in batches:
            v = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([len(v)]), pa.array([float(_norms(v).max()) if v else 0.0]), pa.array([max((len(x) // 8 for x in v), default=0)]), pa.array([float(max((np.abs(np.frombuffer(x, "<i8")).max() for x in v if x), default=0))])], ["n", "norm", "dim", "big"])

    shape = "n long, norm double, dim long, big double"
    s, q = (df.select("vec").mapInArrow(stats, shape).agg(F.sum("n"), F.max("norm"), F.max("dim"), F.max("big")).first() for df in (stored, wanted))
    none = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    if not s[0] or not q[0]:
        return none
    dim = max(s[2], q[2], 1)
    exact = max(s[3], 1) * max(q[3], 1) * dim < 2**53  # then sums of products are exact in doubles
    sample = [bytes(r[0]) for r in stored.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()]
    index = spark.sparkContext.broadcast(Index(sample, dim, s[1], pivots or max(1, min(256, math.isqrt(len(sample)) // 2))))

    def place(batches):
        for b in batches:
            cell, dist = index.value.place(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(dist), b.column(0), b.column(1)], ["cell", "dist", "vec", "ids"])

    keyed = cut(stored.mapInArrow(place, "cell int, dist double, vec binary, ids array<bigint>"))
    cells = {r.cell: (r.n, r.a, r.b) for r in keyed.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("a"), F.max("dist").alias("b")).collect()}  # pivots x rings rows
    known = sorted(cells)
    size = np.array([cells[c][0] for c in known])
    low, high = np.array([cells[c][1] for c in known]), np.array([cells[c][2] for c in known])
    pivot = np.array(known) // RINGS
    grid = spark.sparkContext.broadcast((np.array(known, np.int32), size, low, high, pivot))

    def visits(batches):
        """Annuli of each query: the nearest that hold ``want`` vectors, or all others within the distance of ``kth``."""
        known, size, low, high, pivot = grid.value
        for b in batches:
            vecs, kth = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            x = index.value.lift(vecs, query=True)
            d = _distances(x, index.value.pivots)[:, pivot]
            gap = np.maximum(np.maximum(low[None, :] - d, d - high[None, :]), 0)
            order = np.argsort(gap, axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1)
            home = np.zeros(gap.shape, bool)
            np.put_along_axis(home, order, np.concatenate([np.zeros((len(x), 1), bool), held[:, :-1] >= want * 4], 1) == False, axis=1)  # noqa: E712
            if b.column(1).null_count < len(b.column(1)):
                reach = np.sqrt(np.maximum((x * x).sum(1) + index.value.most - 2 * np.nan_to_num(kth, nan=-np.inf), 0))
                take = ~home & (gap <= reach[:, None] * (1 + 1e-9) + 1e-6)
            else:
                take = home
            i, j = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([pa.array(known[j]), b.column(0).take(pa.array(i)), pa.array(np.nan_to_num(kth, nan=-np.inf)[i])], ["cell", "vec", "kth"])

    blocks = {c: math.ceil(cells[c][0] / block) for c in known}
    split = F.create_map(*[F.lit(v) for c, n in blocks.items() if n > 1 for v in (c, n)]) if any(n > 1 for n in blocks.values()) else None
    n_blocks = (lambda c: F.coalesce(split[c], F.lit(1))) if split is not None else lambda c: F.lit(1)

    def search(t: pa.Table) -> pa.Table:
        part = t.column("part").to_numpy()
        qs, xs = t.filter(pa.array(part == 1)), t.filter(pa.array(part == 0))
        ids = xs.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i][0])
        ids = [ids[i] for i in order]
        xv = xs.column("vec").to_pylist()
        x = _matrix([xv[i] for i in order], dim)
        qv, least = qs.column("vec").to_pylist(), qs.column("kth").to_pylist()
        vecs = [xv[i] for i in order]
        out_q, out_i, out_s, out_o = [], [], [], []
        if ids and qv:
            if not exact:
                x = np.array([np.pad(np.frombuffer(xv[i], "<i8"), (0, dim - len(xv[i]) // 8)) for i in order])
            for at in range(0, len(qv), 512):
                part_q = qv[at : at + 512]
                m = _matrix(part_q, dim) if exact else np.array([np.pad(np.frombuffer(v, "<i8"), (0, dim - len(v) // 8)) for v in part_q])
                score = m @ x.T
                best = _best(score, None, want)
                for v, row, cols, bound in zip(part_q, score, best, least[at : at + 512]):
                    rows = sorted((-int(row[c]), i, vecs[c] == v) for c in cols if row[c] >= bound for i in ids[c])[:want]
                    out_q += [v] * len(rows)
                    out_i += [i for _, i, _ in rows]
                    out_s += [-n for n, _, _ in rows]
                    out_o += [o for _, _, o in rows]
        return pa.table({"vec": pa.array(out_q, pa.binary()), "id": pa.array(out_i, pa.int64()), "score": pa.array(out_s, pa.int64()), "same": pa.array(out_o, pa.bool_())})

    def searched(asks: DataFrame) -> DataFrame:
        """``vec, id, score, same`` (whether the row has the query's vector): the best of every annulus that ``asks(vec, kth)``
        visits, none below ``kth``."""
        to = cut(asks.mapInArrow(visits, "cell int, vec binary, kth double"))
        many = {r.cell: math.ceil(r["count"] / chunk) for r in to.groupBy("cell").count().collect() if r["count"] > chunk}
        chunks = F.create_map(*[F.lit(v) for x in many.items() for v in x]) if many else None
        n_chunks = (lambda c: F.coalesce(chunks[c], F.lit(1))) if many else lambda c: F.lit(1)
        h = lambda n: F.pmod(F.xxhash64("vec"), n.cast("long")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        c = F.col("cell")
        left = keyed.join(F.broadcast(to.select("cell").distinct()), "cell", "left_semi").select("cell", h(n_blocks(c)).alias("b"), every(n_chunks(c)).alias("c"), F.lit(0).alias("part"), "vec", "ids", F.lit(None).cast("double").alias("kth"))
        right = to.select("cell", every(n_blocks(c)).alias("b"), h(n_chunks(c)).alias("c"), F.lit(1).alias("part"), "vec", F.lit(None).cast("array<bigint>").alias("ids"), "kth")
        return left.union(right).groupBy("cell", "b", "c").applyInArrow(search, "vec binary, id bigint, score bigint, same boolean")

    def kept(found: DataFrame) -> DataFrame:
        own = Window.partitionBy("vec").orderBy(F.desc("score"), "id")
        return found.withColumn("r", F.row_number().over(own)).where(F.col("r") <= want)

    first = cut(kept(searched(wanted.select("vec", F.lit(None).cast("double").alias("kth")))))
    bound = first.where(F.col("r") == want).select("vec", F.col("score").cast("double").alias("kth"))
    rest = searched(wanted.join(bound, "vec", "left").select("vec", F.coalesce("kth", F.lit(float("-inf"))).alias("kth")))
    best = kept(first.drop("r").union(rest)).drop("r")
    # one row of a query vector: its k+1 best rows, met by every row that asks for it
    packed = best.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "same"))).alias("best"))
    rows = asked.withColumnRenamed("id", "query_id").join(packed, "vec")
    own = F.array_position(F.transform("best", lambda b: b["same"] & (b["id"] == F.col("query_id"))), True)
    others = F.slice(F.filter(F.transform("best", lambda b, i: F.when(i + 1 != own, b)), lambda b: b.isNotNull()), 1, k)
    each = rows.select("query_id", others.alias("others"), F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return each.select("query_id", F.posexplode("others").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every vector whose id is divisible by 50, against all vectors."""
    every = cut(quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return top_k(every.where(F.col("id") % 50 == 0), every).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.n <> c.n
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
