"""Normalisation: occurrences and findings merged into distinct assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship, stored

CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
HASHES = ["SHA-2", "SHA-3", "BLAKE2", "HMAC"]


def confidence_rank(c: Column) -> Column:
    out = F
    for k, n in CONFIDENCE.items():
        out = out.when(F.lower(c) == k, n)
    return out.otherwise(2)


def key(family: Column, key_size: Column, curve: Column, mode: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat_ws("|", text(family), text(key_size), text(curve), text(mode))


def occurrences(found: DataFrame, by: list[str]) -> DataFrame:
    """One row for each place (file, line) of an asset, that of the highest confidence, the first detector among equals. A
    grouped maximum with partial sums: no window, no sort of the findings."""
    best = F.min(F.struct((-confidence_rank(F.col("confidence"))).alias("c"), "detector", "confidence"))
    return found.groupBy(*by, "file", "line").agg(best.alias("b")).select(*by, "file", "line", "b.confidence", "b.detector")


def assets(places: DataFrame, by: list[str]) -> DataFrame:
    """Distinct assets with their counts."""
    return places.groupBy(*by).agg(F.count("*").alias("n_occ"), F.countDistinct("file").alias("n_files"), F.max(confidence_rank(F.col("confidence"))).alias("best_confidence"))


def without_noise(found: DataFrame) -> DataFrame:
    """Drops assets that were only ever seen with low confidence where the family has one with high confidence. A window over
    the assets of a family, which are few after the grouped merge: the findings are read once."""
    best = clear(found, "family_best")
    held = found.withColumn(best, F.max("best_confidence").over(Window.partitionBy("family")))
    return held.where((F.col("best_confidence") != 1) | (F.col(best) != 3)).drop(best)


def clear(found: DataFrame, wanted: str) -> str:
    while wanted in found.columns:
        wanted += "_"
    return wanted


def inferred_size(family: Column, name: Column, size: Column) -> Column:
    """The digest length in a hash's name where the size is missing."""
    out = F
    for n in (512, 384, 256, 224, 160, 128):
        out = out.when(name.contains(str(n)), n)
    return F.coalesce(size, F.when(family.isin(HASHES), out.otherwise(None)))


def vendored(path: Column, ignored: list[str]) -> Column:
    return F.exists(F.split(F.lower(path), "/"), lambda s: s.isin([x.strip(".").lower() for x in ignored]) | F.ltrim(s, F.lit(".")).isin([x.strip(".").lower() for x in ignored]))


def _greedy(rows):
    import pandas as pd

    fields = ["key_size", "curve", "mode", "padding"]
    rows = rows.astype(object).where(rows.notna(), None)
    items = rows.to_dict("records")
    items.sort(key=lambda r: (-sum(r[f] is not None for f in fields), str(r["name"]), str(r["asset_id"])))
    out: list[dict] = []
    for r in items:
        for a in out:
            if all(r[f] is None or a[f] is None or r[f] == a[f] for f in fields):
                a.update({f: a[f] if a[f] is not None else r[f] for f in fields})
                a["n_occ"] += r["n_occ"]
                a["merged"] += 1
                break
        else:
            out.append(r | {"merged": 1})
    return pd.DataFrame(out)[["family", "kind", "name", *fields, "n_occ", "merged", "asset_id"]]


def wildcard_merged(found: DataFrame) -> DataFrame:
    """Greedy merge of assets of one family and kind whose set parameters don't contradict, the most specific first. The
    order of merging carries state, so each (family, kind) is one group; assets are few after the grouped merge."""
    ship(found.sparkSession)
    cols = ["family", "kind", "name", "key_size", "curve", "mode", "padding", "n_occ", "asset_id"]
    return found.select(*cols).groupBy("family", "kind").applyInPandas(_greedy, "family string, kind string, name string, key_size int, curve string, mode string, padding string, n_occ long, merged int, asset_id string")


PARAMS = ["key_size", "curve", "mode", "padding"]
SETS = 100_000  # parameter sets, about 200 bytes each


def _clusters(rows):
    import pandas as pd

    rows = rows.astype(object).where(rows.notna(), None)
    items = rows.to_dict("records")
    items.sort(key=lambda r: (-sum(r[f] is not None for f in PARAMS), str(r["name"]), [str(r[f]) for f in PARAMS]))
    out: list[tuple[dict, list[dict]]] = []
    for r in items:
        for a, members in out:
            if all(r[f] is None or a[f] is None or r[f] == a[f] for f in PARAMS):
                a.update({f: a[f] if a[f] is not None else r[f] for f in PARAMS})
                members.append(r)
                break
        else:
            out.append(({f: r[f] for f in PARAMS} | {"name": r["name"]}, [r]))
    told = [r | {f"to_{f}": a[f] for f in [*PARAMS, "name"]} for a, members in out for r in members]
    return pd.DataFrame(told)[["family", "kind", "name", *PARAMS, *(f"to_{f}" for f in [*PARAMS, "name"])]]


def compatible(found: DataFrame) -> DataFrame:
    """``found (family, kind, name, PARAMS, confidence, ...)`` with the name and parameters of the asset that each finding is of: one
    with fewer parameters belongs to the first more specific one of its family and kind that doesn't contradict it, whose name stays.
    What decides are the different parameter sets, not the findings: these are grouped first, so a group of the greedy
    merge, whose order carries state, is the parameter sets of one family, however often each was seen. Sets only ever seen with low
    confidence beside better ones are noise and take no part."""
    ship(found.sparkSession)
    by = ["family", "kind", "name", *PARAMS]
    kinds = without_noise(found.groupBy(*by).agg(F.max(confidence_rank(F.col("confidence"))).alias("best_confidence"))).select(*by)
    shape = "family string, kind string, name string, key_size int, curve string, mode string, padding string, to_key_size int, to_curve string, to_mode string, to_padding string, to_name string"
    told = kinds.groupBy("family", "kind").applyInPandas(_clusters, shape).select(*(F.col(c).alias(f"of_{c}") for c in by), F.lit(True).alias("of_any"), *(f"to_{f}" for f in [*PARAMS, "name"]))
    told = stored(told, "sets")
    told = F.broadcast(told) if told.count() <= SETS else told  # a family's findings are many: they stay where they are
    met = found.join(told, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by], "left")
    new = {c: F.when(F.col("of_any"), F.col(f"to_{c}")).otherwise(F.col(c)).alias(c) for c in [*PARAMS, "name"]}
    return met.select(*(new.get(c, F.col(c)) for c in found.columns))


def extras(found: DataFrame, by: str = "asset_key", extra: str = "extra") -> DataFrame:
    """``by, extra``: what the findings of an asset say besides its parameters, a map of each key's different values in order. One value or
    several that contradict each other, in whatever order they were found."""
    each = found.select(by, F.explode(extra).alias("k", "v")).where("v is not null")
    values = each.groupBy(by, "k").agg(F.sort_array(F.collect_set("v")).alias("vs"))
    return values.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "vs")))).alias("extra"))


def first_filled(found: DataFrame, by: list[str], fields: list[str], richness: Column, order: Column) -> DataFrame:
    """One row a group: each field of the richest row that has it, ties by ``order``. A grouped minimum a field, so a group of
    any size needs one value of each."""
    best = lambda f: F.min_by(f, F.struct(F.col(f).isNull().alias("n"), (-richness).alias("r"), order.alias("o"))).alias(f)
    return found.groupBy(*by).agg(*map(best, fields), F.count("*").alias("n_merged"))
