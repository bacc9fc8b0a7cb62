"""Mixing sources to target shares of the total size, with a cap on repeats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Texts of one range of keys.
RANGE_ROWS = 500_000


@dataclass(frozen=True)
class Budget:
    """Of a mix and source: target (share of the targets given), share (of those whose source exists), tokens there are, tokens wanted and tokens to take."""

    mix_name: str
    source: str
    target_share: float
    present_share: float
    max_repeats: int
    available: int
    wanted: int
    budget: int


def budgets(targets: list[tuple[str, str, float, int]], available: dict[str, int], total_tokens: int | None = None) -> list[Budget]:
    """Shares are normalised in each mix; those of sources without tokens fall to the others in proportion, and stay in the result with nothing to take. The total is total_tokens, or
    else the largest at which no source needs more than its repeats, so that all shares are met exactly. With a given total a source that runs out gives all it may."""
    out = []
    for mix in sorted({t[0] for t in targets}):
        own = [t for t in targets if t[0] == mix and t[2] > 0]
        whole, there = sum(t[2] for t in own), sum(t[2] for t in own if available.get(t[1], 0) > 0 and t[3] > 0)
        most = [available[s] * m * there / w for _, s, w, m in own if available.get(s, 0) > 0 and m > 0]
        total = total_tokens if total_tokens is not None else int(min(most, default=0))
        for _, s, w, m in own:
            n = available.get(s, 0) if m > 0 else 0
            share = w / there if n else 0.0
            wanted = round(total * share)
            out.append(Budget(mix, s, w / whole, share, m, n, wanted, min(wanted, n * m)))
    return out


def _targets(spark_targets: DataFrame) -> list[tuple[str, str, float, int]]:
    name = F.lower(F.trim("source"))
    one = spark_targets.filter("mix_name IS NOT NULL AND source IS NOT NULL AND target_share > 0").groupBy("mix_name", name.alias("source")).agg(F.max("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))))
    return [tuple(r) for r in one.collect()]  # a table of fixed size


def selection(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The selection (mix_name, source, doc_id, uses, tokens_taken) and the report (mix_name, source, target_share, present_share, actual_share, available_tokens, budget_tokens,
    taken_tokens, texts, most_uses, max_repeats) from sizes (doc_id, source, tokens).

    Texts of a source are in the order of a hash of their id. Their prefix sums of tokens give the cut: with a budget of e whole rounds and a rest, every text is taken e times and those before
    the rest once more; the last one is cut there (tokens_taken says how much), so that the budget is met to the token. Texts without source or tokens are never taken."""
    spark = sizes.sparkSession
    wanted = _targets(targets)
    names = sorted({t[1] for t in wanted})
    own = sizes.filter(F.col("source").isin(names) & (F.col("tokens") > 0))
    totals = {r["source"]: (r["t"], r["n"]) for r in own.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}  # sources of the targets only
    made = budgets(wanted, {s: t for s, (t, _) in totals.items()}, total_tokens)
    ranges = max(16, max((n for _, n in totals.values()), default=0) // RANGE_ROWS + 1)
    key = F.xxhash64(F.lit(seed), "doc_id")
    # the key is uniform, so that equal ranges of it hold about equally many texts of each source
    keyed = own.select("source", "doc_id", "tokens", key.alias("key")).withColumn("range", F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * ranges).cast("int"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("t")).select("source", "range", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("offset"))
    prefix = keyed.withColumn("here", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(offsets, ["source", "range"])
    plan = spark.createDataFrame(
        [(b.mix_name, b.source, b.budget // b.available, b.budget % b.available) for b in made if b.available], "mix_name string, source string, rounds bigint, rest bigint"
    )
    taken = prefix.withColumn("before", F.col("here") + F.col("offset")).join(F.broadcast(plan), "source")  # a row for each target
    part = F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - F.col("before")))
    chosen = taken.select("mix_name", "source", "doc_id", (F.col("rounds") + (part > 0).cast("int")).alias("uses"), (F.col("rounds") * F.col("tokens") + part).alias("tokens_taken")).filter("uses > 0")
    goals = spark.createDataFrame(
        [(b.mix_name, b.source, b.target_share, b.present_share, b.available, b.budget, b.max_repeats) for b in made],
        "mix_name string, source string, target_share double, present_share double, available_tokens bigint, budget_tokens bigint, max_repeats int",
    )
    got = chosen.groupBy("mix_name", "source").agg(F.sum("tokens_taken").alias("taken_tokens"), F.count(F.lit(1)).alias("texts"), F.max("uses").alias("most_uses"))
    whole = got.groupBy("mix_name").agg(F.sum("taken_tokens").alias("mix_tokens"))
    joined = goals.join(got, ["mix_name", "source"], "left").join(whole, "mix_name", "left").fillna(0, ["taken_tokens", "texts", "most_uses"])
    share = F.coalesce(F.col("taken_tokens") / F.col("mix_tokens"), F.lit(0.0))
    return chosen, joined.select("mix_name", "source", "target_share", "present_share", share.alias("actual_share"), "available_tokens", "budget_tokens", "taken_tokens", "texts", "most_uses", "max_repeats")
