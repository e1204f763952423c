"""Operator 6. SimHash near-dedup: exact linking of 64-bit fingerprints in vantage-point trees.

Fingerprint (the contract of ``op6``): A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, all shingles of ``words`` words
joined by one space (fewer words: the whole sequence), XXH64 with seed 42; a bit is 1 if it is set in over half the
hashes; no words or null text: zero, which links like any other value.

Linking: two distinct fingerprints link at ``radius`` or fewer differing bits. A vantage-point tree, whose inner nodes
split by the median Hamming distance to a vantage point, is built on the driver from a bounded sample
(``SAMPLE`` fingerprints, up to ``MAX_SHARDS`` leaves); each leaf is a shard. A fingerprint is stored in one shard and
queried in every shard that its ball overlaps: at distance d from a vantage point with median m it enters the near
side if d - radius <= m and the far side if d + radius > m (triangle inequality), so that pairs across a boundary meet.
Inside a shard a second, finer tree prunes the same way, down to leaves that are compared bit by bit. Shards larger
than ``BLOCK`` rows are dealt as a grid of data blocks and query chunks, so no task holds more than one of each.

A shard's task emits a star for each of its connected parts instead of all pairs (so does a leaf with more hits than
rows): the components are the same and the edges stay linear in the rows. Equal fingerprints are one node. No pair is lost, none is sampled.

Odd input: null doc_ids take part; a component whose ids are all null has a null component_id. Null and empty texts have
fingerprint zero. Texts of any length are read whole, their hashes counted 32,768 at a time. Repeated rows share a
component. Only ``doc_id`` and ``text`` are read, so other columns can't clash; ``deduplicated`` returns all of them as they
are. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from . import set_join
from .common import clear_name, components, cut, table
from .packed import tidy

RADIUS = 3
JACCARD = 0.8
SAMPLE = 16_384
SHARD = 16_384
MAX_SHARDS = 1024
BLOCK = 65_536
LEAF = 256
TILE = 2_000_000
SPANS = 64  # of the buckets whose counts a task packs


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """``docs``' text column replaced by ``fp`` (the fingerprint as a signed long). Needs no column named fp."""
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c != text]
    rows = docs.select(*names, F.col(text).cast("string").alias(text))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema] + ["fp bigint"])

    @tidy
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                fps = np.array([fingerprint(t, words) for t in part.column(len(names)).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(fps.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(run, schema)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The unsigned hashes of all shingles of one whole text, repeats included: those that ``fingerprint`` counts."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    k, digest = min(words, len(w)), xxhash.xxh64_digest
    joined = b" ".join(w)
    end = np.cumsum([len(x) + 1 for x in w]) - 1
    start = end - [len(x) for x in w]
    return np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(start[: len(w) - k + 1].tolist(), end[k - 1 :].tolist())]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: the bits that are set in over half of them."""
    count, step = np.zeros(64, np.int64), 32_768
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step].astype(">u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big") if len(hashes) else 0


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingle hashes of one whole text, sorted, as signed longs."""
    return np.sort(np.unique(shingle_hashes(text, words)).view(np.int64))


def _set_id(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64))


def set_parities(s: np.ndarray) -> np.ndarray:
    """Eight longs: for each of 512 places, whether an odd number of a set's different signatures ``s`` falls in it."""
    places = 64 * len(set_join.PARITIES)
    return np.packbits((np.bincount(np.mod(s, places), minlength=places) & 1).astype(np.uint8)).view(np.int64)


def set_prints(rows: DataFrame, words: int = 5) -> DataFrame:
    """For each of ``rows(doc_id, th, text)`` its ``doc_id, th``, fingerprint ``fp`` and of its shingle set the hash ``sid``, the size
    ``n`` and the parities; and for each part of the table at most ``SPANS`` rows with a ``span`` of buckets and, packed as
    ``counts``, how many shingles of its sets fall in each of them."""
    ship(rows.sparkSession)

    @tidy
    def run(batches):
        counts = np.zeros(set_join.BUCKETS, np.int64)
        names = ["doc_id", "th", "fp", "sid", "n", *set_join.PARITIES, "span", "counts"]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                fps, sids, sizes, odd = [], [], [], np.zeros((part.num_rows, len(set_join.PARITIES)), np.int64)
                for k, t in enumerate(part.column(2).to_pylist()):
                    h = shingle_hashes(t, words)
                    s = np.sort(np.unique(h).view(np.int64))
                    fps.append(majority(h))
                    sids.append(_set_id(s))
                    sizes.append(len(s))
                    odd[k] = set_parities(s)
                    counts += np.bincount(np.mod(s, set_join.BUCKETS), minlength=set_join.BUCKETS) if len(s) > 20_000 else 0
                    if len(s) <= 20_000:
                        np.add.at(counts, np.mod(s, set_join.BUCKETS), 1)
                own = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64())]
                none = [pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *own, *(pa.array(c) for c in odd.T), *none], names)
        held = [(k, zlib.compress(own.tobytes(), 1)) for k, own in enumerate(counts.reshape(SPANS, -1)) if own.any()]
        none = [pa.nulls(len(held), pa.int64())] * (5 + len(set_join.PARITIES))
        yield pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in held], pa.int32()), pa.array([x for _, x in held], pa.binary())], names)

    schema = ", ".join(f"{c} bigint" for c in ("doc_id", "th", "fp", "sid", "n", *set_join.PARITIES)) + ", span int, counts binary"
    return rows.select("doc_id", "th", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def bucket_frequencies(prints: DataFrame) -> bytes:
    """``set_join.frequencies`` of the packed counts in ``prints``, a result of ``set_prints``. A task adds up its spans as they
    arrive, so it holds their sums only; one byte a bucket reaches the driver."""

    @tidy
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        steps = lambda n: np.minimum(255, 10 * np.log2(1.0 + n)).astype(np.uint8).tobytes()
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(x), np.int64)
                sums[k] = sums[k] + own if k in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([steps(x) for x in sums.values()], pa.binary())], ["span", "often"])

    size = set_join.BUCKETS // SPANS
    out = bytearray(set_join.BUCKETS)
    for r in prints.where("span is not null").select("span", "counts").repartition("span").mapInArrow(run, "span int, often binary").collect():
        out[r.span * size : (r.span + 1) * size] = r.often
    return bytes(out)


def set_keys(docs: DataFrame, often: bytes, t: float, words: int = 5) -> DataFrame:
    """``set_join.prefixes`` of the texts' shingle sets: ``sid, n, pos, sig``, rarest first by the bytes ``often``."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(np.frombuffer(often, np.uint8))  # one byte a bucket

    @tidy
    def run(batches):
        rank = known.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                sids, sizes, firsts = [], [], []
                for text in b.column(0).slice(at, 256).to_pylist():
                    s = shingle_set(text, words)
                    if n := len(s):
                        least = n - math.ceil(t * n - set_join.EDGE) + 1
                        order = np.lexsort((s, rank[np.mod(s, set_join.BUCKETS)]))
                        sids.append(_set_id(s))
                        sizes.append(n)
                        firsts.append(s[order[:least]])
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], ["sid", "n", "first"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "sid bigint, n int, first array<bigint>")
    return rows.dropDuplicates(["sid"]).select("sid", "n", F.posexplode("first").alias("pos", "sig"))


def _median_split(d: np.ndarray) -> int:
    """The distance m that puts the halves ``d <= m`` and ``d > m`` closest to each other in size."""
    counts = np.cumsum(np.bincount(d, minlength=65))
    return int(np.argmin(np.abs(2 * counts - len(d))))


def build_tree(sample: np.ndarray, shards: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Nodes ``(vantage point, median, near, far)``; a child below 0 is shard ``-1 - child``. Of eight candidates the
    vantage point with the widest spread of distances is taken. Deterministic for a sample."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0

    def grow(part: np.ndarray, want: int) -> int:
        nonlocal leaves
        if want > 1 and len(part) >= 8:
            tries = part[rng.choice(len(part), min(8, len(part)), replace=False)]
            vp = max(tries, key=lambda v: float(np.bitwise_count(part ^ v).var()))
            d = np.bitwise_count(part ^ vp)
            m = _median_split(d)
            near = d <= m
            if near.any() and not near.all():
                at = len(nodes)
                nodes.append(None)
                a = grow(part[near], want // 2)
                b = grow(part[~near], want - want // 2)
                nodes[at] = (int(vp), m, a, b)
                return at
        leaves += 1
        return -leaves

    root = grow(np.sort(sample.astype(np.uint64)), shards)
    return nodes if root >= 0 else []


def route(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, shards)``: where each fingerprint is stored (``radius`` None), or every shard that its ball overlaps."""
    if not nodes:
        return np.arange(len(fps)), np.zeros(len(fps), np.int32)
    rows, shards, todo = [], [], [(0, np.arange(len(fps)))]
    while todo:
        at, idx = todo.pop()
        if not len(idx):
            continue
        if at < 0:
            rows.append(idx)
            shards.append(np.full(len(idx), -1 - at, np.int32))
            continue
        vp, m, near, far = nodes[at]
        d = np.bitwise_count(fps[idx] ^ np.uint64(vp)).astype(np.int16)
        r = radius or 0
        todo += [(near, idx[d - r <= m]), (far, idx[d + r > m])]
    return (np.concatenate(rows), np.concatenate(shards)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _linked(d: np.ndarray, q: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges between a leaf's data and the queries that reach it: all pairs, or stars of the connected parts."""
    out = []
    step = max(1, TILE // max(1, len(d)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        hit = (np.bitwise_count(part[:, None] ^ d[None, :]) <= radius) & (part[:, None] != d[None, :])
        if (n := int(hit.sum())) == 0:
            continue
        if n <= 2 * (len(part) + len(d)):
            i, j = np.nonzero(hit)
            out.append((part[i], d[j]))
            continue
        name_q, name_d = np.arange(len(part), dtype=np.int64), len(part) + np.arange(len(d), dtype=np.int64)
        same = part[:, None] == d[None, :]
        hit |= same
        big = len(part) + len(d)
        while True:
            new_d = np.minimum(name_d, np.where(hit, name_q[:, None], big).min(0))
            new_q = np.minimum(name_q, np.where(hit, new_d[None, :], big).min(1))
            if (new_d == name_d).all() and (new_q == name_q).all():
                break
            name_d, name_q = new_d, new_q
        every = np.concatenate([part, d])
        for names, own in ((name_q, part), (name_d, d)):
            a = every[names]
            out.append((own[a != own], a[a != own]))
    return out


def near_pairs(d: np.ndarray, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect every query with every datum within ``radius`` bits, by a vantage-point tree over the data."""
    found, todo, k = [], [(d, q)], 0
    while todo:
        d, q = todo.pop()
        if not len(d) or not len(q):
            continue
        if len(d) > LEAF:
            k += 1
            vp = d[(k * 2_654_435_761) % len(d)]
            dist = np.bitwise_count(d ^ vp)
            m = _median_split(dist)
            near = dist <= m
            if near.any() and not near.all():
                to = np.bitwise_count(q ^ vp).astype(np.int16)
                todo += [(d[near], q[to - radius <= m]), (d[~near], q[to + radius > m])]
                continue
        found += _linked(d, q, radius)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*found))
    return a, b


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges ``a, b`` with each connected part turned into a star: one edge a node, to the part's smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in set(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    top = np.array([root(x) for x in range(len(up))], np.int64)
    own = top != np.arange(len(up))
    return nodes[own], nodes[top[own]]


def links(distinct: DataFrame, radius: int = RADIUS, fp: str = "fp", shard: int = SHARD, block: int = BLOCK, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Edges ``a, b`` (signed longs) whose connected components are those of all pairs of the distinct non-null
    fingerprints in ``distinct`` at ``radius`` bits or fewer."""
    spark = distinct.sparkSession
    ship(spark)
    fps = distinct.select(F.col(fp).alias("fp"))
    n = fps.count()
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    nodes = build_tree(sample, max(1, min(max_shards, math.ceil(n / shard))))
    tree = spark.sparkContext.broadcast(nodes)  # at most max_shards nodes

    def deal(batches):
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            for radius_, role in ((None, 0), (radius, 1)):
                rows, to = route(own, tree.value, radius_)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(rows), role, np.int8)), pa.array(own[rows].view(np.int64))], ["shard", "role", "fp"])

    dealt = fps.mapInArrow(deal, "shard int, role tinyint, fp bigint")
    # Grid of blocks for shards that are too large for one task; the counts are one row a shard.
    sizes = {(r.shard, r.role): r["count"] for r in dealt.groupBy("shard", "role").count().collect()} if nodes or n > block else {}
    cells = {s: (max(1, math.ceil(sizes.get((s, 0), 0) / block)), max(1, math.ceil(sizes.get((s, 1), 0) / (4 * block)))) for s, _ in sizes}
    large = {s: g for s, g in cells.items() if g != (1, 1)}
    if large:
        grid = F.create_map(*[F.lit(x) for s, (a, b) in large.items() for x in (s, f"{a},{b}")])
        g = F.split(F.coalesce(grid[F.col("shard")], F.lit("1,1")), ",")
        own = F.pmod(F.xxhash64("fp"), F.when(F.col("role") == 0, g[0].cast("long")).otherwise(g[1].cast("long"))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, g[1].cast("int")).otherwise(g[0].cast("int")) - 1))
        dealt = dealt.select("shard", "role", "fp", own.alias("own"), other.alias("other"))
        dealt = dealt.select("shard", F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")).alias("x"), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own")).alias("y"), "role", "fp")
    else:
        dealt = dealt.select("shard", F.lit(0).alias("x"), F.lit(0).alias("y"), "role", "fp")

    def meet(t: pa.Table) -> pa.Table:
        role, f = t.column("role").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        a, b = near_pairs(f[role == 0], f[role == 1], radius)
        a, b = stars(a.view(np.int64), b.view(np.int64))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return dealt.groupBy("shard", "x", "y").applyInArrow(meet, "a bigint, b bigint")


def grouped(prints: DataFrame, radius: int = RADIUS, **how) -> DataFrame:
    """``fp, label``: the component of every distinct fingerprint of ``prints`` (label: one of its fingerprints)."""
    distinct = cut(prints.select("fp").distinct())
    comps = components(links(distinct, radius, **how))
    return distinct.join(comps, distinct["fp"] == comps["node"], "left").select("fp", F.coalesce("component", "fp").alias("label"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest doc_id reachable by links,
    for every row of ``docs``."""
    prints = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words))
    label = grouped(prints, radius)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(label, "fp")
    to = least.join(least.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id")
    return prints.join(to, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every whole document."""
    return near_groups(table(spark, sf_dir, "documents"))


def confirmed_texts(pairs: DataFrame, prints: DataFrame, rows: DataFrame, words: int, jaccard: float) -> DataFrame:
    """The pairs of sids ``a, b`` whose shingle sets have a Jaccard coefficient of ``jaccard`` or more. One text of each sid is
    moved to its pairs: texts are less than half of their sets' size, and compress."""
    ship(pairs.sparkSession)
    pairs = cut(pairs.select("a", "b").distinct())
    ids = cut(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct())
    of = cut(set_join.chosen(prints, ids, "sid").groupBy("sid").agg(F.min("th").alias("th")))
    few = of.count() <= set_join.BROADCAST
    texts = rows.select("th", "text").join(F.broadcast(of) if few else of, "th").groupBy("sid").agg(F.first("text").alias("text"))

    @tidy
    def run(batches):
        seen: dict[int, np.ndarray] = {}

        def found(sid: int, text: str) -> np.ndarray:
            if sid not in seen:
                if len(seen) >= 256:
                    seen.clear()
                seen[sid] = shingle_set(text, words)
            return seen[sid]

        for batch in batches:
            near = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = found(a, x), found(b, y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= jaccard / (1 + jaccard) * (len(x) + len(y)) - set_join.EDGE)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    # both sides read one exchange of the texts by sid
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint")


def confirmed_links(prints: DataFrame, rows: DataFrame, words: int, radius: int, jaccard: float, keys: DataFrame, often: bytes) -> DataFrame:
    """Edges ``a, b`` between the shingle sets of ``prints(sid, fp, th, n, *PARITIES)`` whose components are those of all pairs of a Jaccard
    coefficient of ``jaccard`` or more. The trees give the pairs within ``radius`` bits; whole sets confirm them. Pairs
    further apart, which share so little of 64 bits that no tree prunes them, are left to the set join, which takes the
    classes found so far as known."""
    confirm = functools.partial(confirmed_texts, prints=prints, rows=rows, words=words, jaccard=jaccard)
    of = cut(prints.groupBy("fp", "sid").agg(F.lit(1)).select("fp", "sid"))
    least = cut(of.groupBy("fp").agg(F.min("sid").alias("first")))
    same = of.join(least, "fp").where("sid <> first").select(F.col("sid").alias("a"), F.col("first").alias("b"))
    near = links(least.select("fp"), radius)
    for c in "ab":
        near = near.join(least.select(F.col("fp").alias(c), F.col("first").alias(f"s{c}")), c)
    pairs = same.union(near.select("sa", "sb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    known = cut(confirm(pairs))
    parities = cut(prints.select("sid", "n", *set_join.PARITIES).dropDuplicates(["sid"]))
    return set_join.links(None, jaccard, confirm, known, keys, parities, often)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS, jaccard: float | None = None) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: that with the smallest doc_id (a null one only if all are
    null), the smallest text hash among equal ids, any one of equal rows. All columns stay as they are. Groups are those
    of fingerprints within ``radius`` bits or, if ``jaccard`` is given, of shingle sets of that likeness or more."""
    pick = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    if jaccard is None:
        prints = cut(fingerprints(pick, words=words))
        label = grouped(prints, radius)
    else:
        both = cut(set_prints(pick, words))
        often = bucket_frequencies(both)
        prints = both.where("span is null").drop("span", "counts")
        edges = confirmed_links(prints, pick, words, radius, jaccard, set_keys(pick, often, jaccard, words), often)
        comps = components(edges)
        prints = prints.select("doc_id", "th", F.col("sid").alias("fp"))
        label = prints.select("fp").distinct().join(comps, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("label"))
    best = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th")).alias("best"))
    keep = best.join(label, "fp").groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("k_id"), F.col("best.th").alias("k_th"))
    keep = cut(keep)
    own = {c: clear_name(docs, c) for c in ("k_id", "k_th")}
    k = keep.select(F.col("k_id").alias("a"), F.col("k_th").alias("b"))
    rest = prints.join(k, F.col("doc_id").eqNullSafe(k["a"]) & (F.col("th") == k["b"]), "left_anti").select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"))
    # The smaller of both lists meets the texts: texts are only moved where what goes is too much to broadcast.
    few = rest.limit(set_join.BROADCAST + 1).count() <= set_join.BROADCAST
    listed = (F.broadcast(rest.distinct()) if few else keep).select(*(F.col(a).alias(b) for a, b in own.items()))
    same = docs[doc_id].cast("bigint").eqNullSafe(listed[own["k_id"]]) & (F.xxhash64(docs[text]) == listed[own["k_th"]])
    out = docs.join(listed, same, "left_anti" if few else "left_semi")
    rows = prints.groupBy("doc_id", "th").count().where("count > 1")
    if rows.join(k, rows["doc_id"].eqNullSafe(k["a"]) & (rows["th"] == k["b"]), "left_semi").limit(1).count():
        out = out.dropDuplicates([doc_id, text])  # rows with the same id and text
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays: five-word shingle sets of a Jaccard coefficient of
    ``JACCARD`` or more, exactly. Fingerprints of five-word shingles are linked in the vantage-point trees at ``RADIUS`` bits
    and confirmed by their sets. Pairs at the least likeness differ by up to some 16 bits, which no tree over 64 bits
    prunes, so an exact set join (``set_join``) completes the classes that the trees give."""
    return deduplicated(docs, words=5, jaccard=JACCARD)
