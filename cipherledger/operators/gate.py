"""The CI gate: ignores, floor, waivers, budgets and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import policy as P


def flagged(assets: DataFrame, fail_on: str | None = "critical", floor: str = "none", mosca_blocks: bool = False, ignore: list[str] = (), places: DataFrame | None = None) -> DataFrame:
    """``assets (asset_key, severity, act_now, ...)`` with ``ignored, below, blocking``. An asset is ignored only if each of its
    ``places (asset_key, file)`` is. A threshold of None switches the gate off, late assets included; ``none`` blocks on every
    asset."""
    rank = F.col("severity_rank")
    at = {"critical": 4, "high": 3, "medium": 2, "low": 1, "none": 0}
    late = F.col("act_now") & F.lit(mosca_blocks)
    out = assets.withColumn("ignored", F.lit(False))
    if ignore:
        if places is None:
            raise ValueError("ignored paths are judged by all places of an asset")
        whole = places.groupBy("asset_key").agg(F.bool_and(P.ignored(F.col("file"), list(ignore))).alias("ignored"))
        out = assets.join(whole, "asset_key", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
    ign = F.col("ignored")
    below = ~ign & (rank < at[floor]) & ~late
    block = ~ign & ~below & ((rank >= at[fail_on]) | late) if fail_on else F.lit(False)
    return out.withColumn("below", below).withColumn("blocking", block).select(*assets.columns, "ignored", "below", "blocking")


def expired(expires, reason, today: str):
    """Fail closed: a waiver needs a reason and a date that is not past."""
    day = F.expr("try_to_date(substr(expires, 1, 10), 'yyyy-MM-dd')")
    return F.coalesce(day < F.lit(today).cast("date"), F.lit(True)) | (F.trim(F.coalesce(reason, F.lit(""))) == "")


#: What a waiver can name; a severity is no such field, so a waiver with nothing else matches nothing.
FIELDS = ("key", "name", "family", "file_regex")


def waived(assets: DataFrame, waivers: DataFrame, today: str, places: DataFrame) -> DataFrame:
    """``assets`` with ``waiver_ord, waiver_expired``: the first active waiver that matches, else the first expired one. A
    waiver (ord, family, file_regex, reason, expires, and key and name if it has them) matches where every field it has does;
    its key is family, size, curve and mode, with which an asset's key begins; a file pattern matches only if all ``places (asset_key, file)`` of the asset fit; one without any
    field matches nothing. Waivers are the rows of a policy file, so the driver knows them: each is one expression, and all
    patterns are one grouped aggregation of the places."""
    rows = [r.asDict() for r in waivers.withColumn("dead", expired(F.col("expires"), F.col("reason"), today)).collect()]
    rows = [w for w in rows if any(w.get(f) is not None for f in FIELDS)]
    out = assets
    if patterns := sorted({w["file_regex"] for w in rows if w["file_regex"] is not None}):
        fits = [F.bool_and(F.rlike(F.col("file"), F.lit(p))).alias(f"fits_{k}") for k, p in enumerate(patterns)]
        out = assets.join(places.groupBy("asset_key").agg(*fits), "asset_key", "left")
    hits: dict[bool, list[Column]] = {False: [], True: []}
    for w in sorted(rows, key=lambda w: w["ord"]):
        yes = F.lit(True)
        for field, have in (("key", F.substring_index("asset_key", "|", 4)), ("name", F.col("name"))):
            if w.get(field) is not None:
                yes &= F.coalesce(have == F.lit(w[field]), F.lit(False))
        if w["family"] is not None:
            yes &= F.coalesce(F.lower("family") == F.lit(w["family"].lower()), F.lit(False))
        if w["file_regex"] is not None:
            yes &= F.coalesce(F.col(f"fits_{patterns.index(w['file_regex'])}"), F.lit(False))
        hits[w["dead"]].append(F.when(yes, F.lit(w["ord"]).cast("int")))
    none = F.lit(None).cast("int")
    active, dead = (F.coalesce(none, *hits[k]) for k in (False, True))
    return out.select(*assets.columns, F.coalesce(active, dead).alias("waiver_ord"), F.when(active.isNotNull(), False).when(dead.isNotNull(), True).alias("waiver_expired"))


def _waived() -> Column:
    return F.coalesce(~F.col("waiver_expired"), F.lit(False))


def verdict(assets: DataFrame, budgets: dict[str, int] = {}, on: bool = True, errors: int = 0, errors_block: bool = False) -> DataFrame:
    """One row: counts, the severities over budget, and the exit code: 0 pass, 1 fail, 2 if nothing fails but there are scan
    errors, which the policy may let block. Budgets count what is reported, so neither ignored assets nor those below the floor;
    none applies where the gate is off."""
    live = ~F.col("ignored") & ~F.col("below")
    blown = F.lit(0)
    for s, n in budgets.items() if on else ():
        blown = blown + (F.count_if(live & (F.col("severity") == s)) > n).cast("int")
    code = F.when((F.col("n_blocking") > 0) | (F.col("n_over_budget") > 0), 1).otherwise(2 if errors and errors_block else 0)
    return assets.agg(
        F.count("*").alias("n_assets"),
        F.count_if("ignored").alias("n_ignored"),
        F.count_if("below").alias("n_below"),
        F.count_if(F.col("blocking") & ~_waived()).alias("n_blocking"),
        F.count_if(F.col("blocking") & _waived()).alias("n_waived"),
        F.count_if(F.col("blocking") & F.coalesce("waiver_expired", F.lit(False))).alias("n_expired"),
        blown.cast("long").alias("n_over_budget"),
    ).withColumn("exit_code", code.cast("int"))


def offenders(assets: DataFrame, n: int = 10) -> DataFrame:
    """The first assets that block, worst first; waived ones don't."""
    return assets.where(F.col("blocking") & ~_waived()).orderBy(F.desc("severity_rank"), F.desc("score"), "name", "asset_key").limit(n)


def summary(v: dict, listed: list[dict], fail_on: str | None, errors: list[str] = ()) -> str:
    """The text that CI prints, from the row of ``verdict`` and the rows of ``offenders``."""
    head = {0: "PASS", 1: "FAIL", 2: "ERROR"}[v["exit_code"]]
    out = [f"gate: {head} (threshold: {fail_on or 'off'})", f"  {v['n_assets']} assets, {v['n_blocking']} blocking, {v['n_waived']} waived, {v['n_expired']} with an expired waiver, {v['n_below']} below the floor, {v['n_ignored']} ignored"]
    if v["n_over_budget"]:
        out.append(f"  {v['n_over_budget']} severities over budget")
    for a in listed:
        place = f"{a['file']}:{a['line']}" if a.get("file") else "(no location)"
        out.append(f"  {a['severity']:>8} {a['score']:6.1f}  {cut_right(a['name'], 34):34}  {cut_left(place, 48)}")
    if v["n_blocking"] > len(listed):
        out.append(f"  ... and {v['n_blocking'] - len(listed)} more")
    return "\n".join([*out, *(f"  error: {e}" for e in errors)])


def cut_right(text: str, width: int) -> str:
    return text if len(text) <= width else text[: width - 1] + "~"


def cut_left(text: str, width: int) -> str:
    """Leading folders go, never the file's name and line."""
    return text if len(text) <= width else "~" + text[1 - width :]
