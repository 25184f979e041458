"""Elo ratings.

Sequential Elo links every contest to both sides' previous contests, so it is not a
per-key window. Two forms are offered:

* ``period_elo``: ratings are frozen inside a period and updated once at its end. Each
  period is one join and one aggregation over that period's contests, so it scales out;
  it equals sequential Elo whenever nobody plays twice in a period (an event day).
* ``pool_elo``: exact sequential Elo inside independent pools. Rows stream through the
  task in order and only the pool's current ratings are kept, but one pool is serial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelmark.functions._col import col
from duelmark.session import materialize, scratch_path

BASE, K, FINISH_BONUS = 1500.0, 32.0, 8.0


def k_factor(method, k: float = K, finish_bonus: float = FINISH_BONUS) -> Column:
    text = F.upper(F.coalesce(col(method), F.lit("")))
    return F.lit(k) + F.when(text.contains("KO") | text.contains("SUB"), finish_bonus).otherwise(0.0)


def score_a(winner) -> Column:
    return F.when(col(winner) == "A", 1.0).when(col(winner) == "B", 0.0).otherwise(0.5)


def period_elo(bouts: DataFrame, contest: str, period: str, a: str, b: str, winner: str, method: str,
               k: float = K, base: float = BASE, finish_bonus: float = FINISH_BONUS,
               checkpoint_every: int = 8) -> tuple[DataFrame, DataFrame]:
    """Returns (contests with elo_a_pre/elo_b_pre/elo_diff, final ratings).

    Periods are read in order, one value at a time. Ratings are
    one row per entity; their lineage is cut through the shared folder every few periods.
    """
    spark = bouts.sparkSession
    rows = bouts.select(contest, F.col(period).alias("_period"), a, b,
                        score_a(winner).alias("_s"), k_factor(method, k, finish_bonus).alias("_k"))
    stored = materialize(rows, "elo-contests", partition_by="_period")

    ratings = spark.createDataFrame([], "entity string, rating double")
    ratings = ratings.withColumn("entity", F.col("entity").cast(bouts.schema[a].dataType))
    folder = scratch_path(spark, "elo-periods")
    n = 0
    n = 0
    periods = stored.select("_period").distinct().orderBy("_period")
    for n, (p,) in enumerate(periods.toLocalIterator(), 1):
        now = stored.filter(F.col("_period") == F.lit(p))
        sides = now.withColumn("_e", F.explode(F.array(
            F.struct(F.col(a).alias("entity"), F.lit("a").alias("side")),
            F.struct(F.col(b).alias("entity"), F.lit("b").alias("side"))))).select(contest, "_s", "_k", "_e.*")
        rated = sides.join(ratings, "entity", "left").withColumn("rating", F.coalesce("rating", F.lit(base)))
        pre = rated.groupBy(contest, "_s", "_k").agg(
            F.max(F.when(F.col("side") == "a", F.col("entity"))).alias("_a"),
            F.max(F.when(F.col("side") == "b", F.col("entity"))).alias("_b"),
            F.max(F.when(F.col("side") == "a", F.col("rating"))).alias("elo_a_pre"),
            F.max(F.when(F.col("side") == "b", F.col("rating"))).alias("elo_b_pre"))
        expected = 1.0 / (1.0 + F.pow(F.lit(10.0), (F.col("elo_b_pre") - F.col("elo_a_pre")) / 400.0))
        pre = pre.withColumn("_delta", F.col("_k") * (F.col("_s") - expected))
        path, schema = f"{folder}/n={n}", pre.schema
        pre.write.parquet(path)
        pre = spark.read.schema(schema).parquet(path)
        moves = pre.select(F.explode(F.array(
            F.struct(F.col("_a").alias("entity"), F.col("_delta").alias("d")),
            F.struct(F.col("_b").alias("entity"), (-F.col("_delta")).alias("d")))).alias("m")).select("m.*")
        # one aggregation merges old ratings and moves: no outer join
        old = ratings.select("entity", F.col("rating").alias("r"), F.lit(0.0).alias("d"))
        new = moves.select("entity", F.lit(None).cast("double").alias("r"), "d")
        ratings = (old.unionByName(new).groupBy("entity")
                   .agg((F.coalesce(F.max("r"), F.lit(base)) + F.sum("d")).alias("rating")))
        if n % checkpoint_every == 0:
            ratings = materialize(ratings, "elo-ratings")
    if n == 0:
        return bouts.withColumns({c: F.lit(None).cast("double") for c in ("elo_a_pre", "elo_b_pre", "elo_diff")}), ratings
    ratings = materialize(ratings, "elo-ratings")
    pre_all = spark.read.schema(schema).parquet(f"{folder}/*").select(contest, "elo_a_pre", "elo_b_pre")
    out = bouts.join(pre_all, contest).withColumn("elo_diff", F.col("elo_a_pre") - F.col("elo_b_pre"))
    return out, ratings


def pool_elo(bouts: DataFrame, pool: str, time: str, seq: str, contest: str, a: str, b: str, winner: str,
             method: str, k: float = K, base: float = BASE, finish_bonus: float = FINISH_BONUS) -> DataFrame:
    """Exact sequential Elo per pool (for example one ladder or season).

    Pools are spread over tasks; inside a task sorted batches stream through, so memory
    holds the current pool's ratings only.
    """
    rows = bouts.select(*dict.fromkeys([pool, time, seq, contest, a, b]), score_a(winner).alias("_s"),
                        k_factor(method, k, finish_bonus).alias("_k"))
    sorted_rows = rows.repartition(F.col(pool)).sortWithinPartitions(pool, time, seq)
    schema = f"{contest} {bouts.schema[contest].dataType.simpleString()}, elo_a_pre double, elo_b_pre double"
    names = (pool, contest, a, b)

    def stream(batches):
        import pandas as pd

        pool_c, contest_c, a_c, b_c = names
        current, ratings = None, {}
        for batch in batches:
            pre_a, pre_b = [], []
            for where, x, y, s, step in zip(batch[pool_c], batch[a_c], batch[b_c], batch["_s"], batch["_k"]):
                if where != current:
                    current, ratings = where, {}
                ra, rb = ratings.get(x, base), ratings.get(y, base)
                pre_a.append(ra)
                pre_b.append(rb)
                move = step * (s - 1.0 / (1.0 + 10 ** ((rb - ra) / 400.0)))
                ratings[x] = ra + move
                ratings[y] = rb - move
            yield pd.DataFrame({contest_c: batch[contest_c], "elo_a_pre": pre_a, "elo_b_pre": pre_b})

    rated = sorted_rows.mapInPandas(stream, schema)
    return bouts.join(rated, contest).withColumn("elo_diff", F.col("elo_a_pre") - F.col("elo_b_pre"))
