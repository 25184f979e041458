"""Date-tolerant joins, identity resolution and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelmark.checks import assert_unique
from duelmark.functions.names import unresolved_key
from duelmark.functions.parsing import division_limit
from duelmark.operators.keys import keep_first
from duelmark.settings import TERMINAL_STATUSES


def lookup(df: DataFrame, table: DataFrame, keys: list[str], validate: bool = True) -> DataFrame:
    """Left join to a table that must be unique on ``keys`` (many-to-one).

    No size is assumed: with AQE the join becomes a broadcast only when the measured
    size of ``table`` is below the session threshold.
    """
    if validate:
        assert_unique(table, keys, "lookup table")
    return df.join(table, keys, "left")


def nearest_date(left: DataFrame, right: DataFrame, left_id: list[str], keys: list[str],
                 left_time: str, right_time: str, days: int = 1,
                 tie: list[str] = ()) -> DataFrame:
    """Inner join to the closest right row within ``days``; ties go to the earlier time.

    No pairs are formed. Both sides are merged per (keys, day) in time order, where the
    nearest right row before and after each left row is one window lookup. A day also
    receives the last right row of the days before it and the first one of the days after
    it, so a key is split into days and neighbours across midnight are still found.
    """
    rest = [c for c in right.columns if c not in keys]
    first_at_time = keep_first(right.dropna(subset=[*keys, right_time]), [*keys, right_time], [*tie, right_time])
    r = first_at_time.select(*keys, F.col(right_time).cast("timestamp").alias("_t"), F.struct(*rest).alias("_r"))
    r = r.withColumn("_day", F.col("_t").cast("date"))
    edges = r.groupBy(*keys, "_day").agg(
        F.max_by(F.struct("_t", "_r"), "_t").alias("last"), F.min_by(F.struct("_t", "_r"), "_t").alias("first"))

    def carried(edge, sign):
        shift = F.explode(F.array(*[F.lit(sign * n) for n in range(1, days + 1)])).alias("_shift")
        return edges.select("*", shift).select(
            *keys, F.col(f"{edge}._t").alias("_t"), F.col(f"{edge}._r").alias("_r"), F.date_add("_day", F.col("_shift")).alias("_day"))

    context = r.unionByName(carried("last", 1)).unionByName(carried("first", -1))
    l = left.withColumns({"_t": F.col(left_time).cast("timestamp"), "_left": F.lit(True)})
    l = l.withColumn("_day", F.col("_t").cast("date"))
    both = l.unionByName(context, allowMissingColumns=True)
    order = W.partitionBy(*keys, "_day").orderBy("_t")
    mark = F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))
    # rows of one time are peers of a range frame: an exact hit counts on both sides. Both frames grow forward, each in
    # its own order; a frame that shrinks would be scanned again for every row
    back = W.partitionBy(*keys, "_day").orderBy(F.col("_t").desc())
    near = both.withColumns({
        "_before": F.last(mark, ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, 0)),
        "_after": F.last(mark, ignorenulls=True).over(back.rangeBetween(W.unboundedPreceding, 0))}).filter("_left")

    def gap(c):
        return F.abs(F.unix_micros("_t") - F.unix_micros(f"{c}._t")) / 8.64e10

    use_after = F.col("_before").isNull() | (gap("_after") < gap("_before"))
    hit = near.withColumn("_hit", F.when(use_after, F.col("_after")).otherwise(F.col("_before")))
    hit = hit.withColumn("date_error_days", gap("_hit")).filter(F.col("date_error_days") <= days)
    new = [c for c in rest if c not in left.columns]
    return hit.select(*left.columns, *[F.col(f"_hit._r.{c}").alias(c) for c in new], "date_error_days")


def preferred_offset(left: DataFrame, right: DataFrame, left_id: list[str], keys: list[str],
                     left_date: str, right_date: str, offsets=(0, -1, 1),
                     how: str = "inner") -> DataFrame:
    """Right row at the first matching day offset, in order of preference.

    ``right`` is unique on (keys, right_date).
    """
    ranked = F.explode(F.array(*[F.struct(F.lit(n).alias("rank"), F.lit(o).alias("days"))
                                 for n, o in enumerate(offsets)])).alias("_o")
    l = left.select("*", ranked).withColumn(right_date, F.date_add(left_date, F.col("_o.days")))
    hit = l.join(right, [*keys, right_date]).withColumn("offset_rank", F.col("_o.rank")).drop("_o")
    best = keep_first(hit, left_id, ["offset_rank"])
    if how == "inner":
        return best
    new = [c for c in best.columns if c not in left.columns]
    return left.join(best.select(*left_id, *new), left_id, "left")


def resolve_identity(rows: DataFrame, registry: DataFrame, name_key: str, division: str,
                     weight: str = "registered_weight", ident: str = "entity_id") -> DataFrame:
    """Resolve (name, division) to one registry id.

    One candidate wins outright. Several: the single nearest registered weight, or, when
    the division is unknown, the only candidate with a weight. Only distinct (name,
    division) pairs are resolved and joined back, so repeated names cost nothing extra.
    Adds ``resolution`` in ('unique', 'by_weight', 'ambiguous', 'not_found').
    """
    wanted = rows.select(name_key, division).distinct()
    cand = registry.select(F.col("name_key").alias(name_key), ident, weight)
    pairs = wanted.withColumn("_limit", division_limit(division)).join(cand, name_key, "left")
    gap = F.abs(F.col(weight) - F.col("_limit"))
    scored = pairs.withColumn("_gap", gap)
    best = scored.groupBy(name_key, division).agg(
        F.count(ident).alias("_n"), F.count(weight).alias("_known"),
        F.max("_limit").alias("_limit"), F.min("_gap").alias("_min"),
        F.min(ident).alias("_any"), F.min(F.when(F.col(weight).isNotNull(), F.col(ident))).alias("_weighed"))
    near = (scored.join(best.select(name_key, division, "_min"), [name_key, division])
            .filter(F.col("_gap") == F.col("_min"))
            .groupBy(name_key, division)
            .agg(F.count(F.lit(1)).alias("_ties"), F.min(ident).alias("_near")))
    r = best.join(near, [name_key, division], "left")
    by_weight = (F.col("_limit").isNotNull() & (F.col("_ties") == 1))
    only_known = F.col("_limit").isNull() & (F.col("_known") == 1)
    r = r.select(
        name_key, division,
        F.when(F.col("_n") == 1, F.col("_any")).when(by_weight, F.col("_near"))
        .when(only_known, F.col("_weighed")).alias(ident),
        F.when(F.col("_n") == 1, "unique").when(by_weight | only_known, "by_weight")
        .when(F.col("_n") == 0, "not_found").otherwise("ambiguous").alias("resolution"))
    # division may be NULL: match it null-safely
    out = rows.alias("l").join(
        r.alias("r"), (F.col(f"l.{name_key}") == F.col(f"r.{name_key}"))
        & F.col(f"l.{division}").eqNullSafe(F.col(f"r.{division}")), "left")
    return out.select("l.*", f"r.{ident}", "r.resolution")


def resolve_or_mark(rows: DataFrame, registry: DataFrame, name_key: str, division: str,
                    strict: bool = False, ident: str = "entity_id", **kw) -> DataFrame:
    """``resolve_identity`` with ``unresolved:<name>`` ids, or an error when ``strict``."""
    out = resolve_identity(rows, registry, name_key, division, ident=ident, **kw)
    if strict:
        from duelmark.checks import assert_empty
        assert_empty(out.filter(F.col(ident).isNull()).select(name_key, division, "resolution").distinct(),
                     "identity not resolved")
    return out.withColumn(ident, F.coalesce(ident, unresolved_key(name_key)))


def build_registry(registry: DataFrame, details: DataFrame, name: str, url: str, ident: Column,
                   name_key: Column, weight: Column, seq: str) -> DataFrame:
    """Registry union details (missing columns NULL), first row per (name key, id).

    Raises on an empty id or one id with several URLs.
    """
    from duelmark.checks import assert_empty
    from duelmark.operators.keys import conflicting_mapping

    both = registry.unionByName(details, allowMissingColumns=True)
    both = both.withColumns({"entity_id": ident, "name_key": name_key, "registered_weight": weight})
    assert_empty(both.filter(F.coalesce("entity_id", F.lit("")) == "").select(name, url),
                 "registry has a missing or invalid URL")
    first = keep_first(both, ["name_key", "entity_id"], [seq])
    assert_empty(conflicting_mapping(first, "entity_id", url), "registry maps one id to several URLs")
    return first


def resume_worklist(wanted: DataFrame, manifest: DataFrame, event: str, kind: str, status: str,
                    start: str, seq: list[str]) -> DataFrame:
    """Attempts still to make, each with the event start discovered so far.

    Terminal (event, kind) attempts are removed; the last successful discovery wins.
    """
    done = manifest.filter(F.col(status).isin(*TERMINAL_STATUSES)).select(event, kind)
    starts = (manifest.filter(F.col(kind).startswith("discovery_") & (F.col(status) == "ok")
                              & F.col(start).isNotNull())
              .groupBy(event).agg(F.max_by(start, F.struct(*seq)).alias("known_start")))
    return wanted.join(done, [event, kind], "left_anti").join(starts, event, "left")


def required_pairs(payload: DataFrame, wanted: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Payload rows whose pair is wanted, and the earliest start among them per card."""
    return payload.join(wanted.select(*keys), keys, "left_semi")


def fold_copies(rows: DataFrame, time: str, folds: list, name: str = "fold") -> DataFrame:
    """Walk-forward: copy each row to every fold that starts strictly after it.

    ``folds`` is the sorted list of fold times (one value per refit). The copies
    come from a slice of a literal array, so there is no theta join and no shuffle.
    """
    grid = F.array(*[F.lit(f) for f in sorted(folds)])
    later = F.filter(grid, lambda f: f > F.col(time))
    return rows.withColumn(name, F.explode(later))


def fold_totals(rows: DataFrame, time: str, folds: DataFrame, values: list[str], bucket) -> DataFrame:
    """Walk-forward sums: per fold the number of rows strictly before it and the sums of ``values`` over them.

    ``folds`` is a table of fold times under the name ``time``, of any length. Rows are summed per time once and run up in order of time in two
    levels (``bucket`` never decreases along it), so that no row is copied to a fold.
    """
    from duelmark.operators.running import running_before

    parts = rows.select(time, F.lit(1).cast("long").alias("n"), *values, F.lit(False).alias("_fold"))
    marks = folds.select(time, F.lit(0).cast("long").alias("n"), *[F.lit(None).cast(rows.schema[v].dataType).alias(v) for v in values], F.lit(True).alias("_fold"))
    per = parts.unionByName(marks).groupBy(time).agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values], F.max("_fold").alias("_fold"))
    return running_before(per, time, ["n", *values], bucket).filter("_fold").drop("_fold")
