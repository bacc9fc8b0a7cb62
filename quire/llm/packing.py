"""Filling containers of fixed capacity with whole texts, planned on the histogram of their lengths.

The plan is made on the driver from counts by length (at most `capacity` rows, whatever the input); texts then take the planned places by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket when ranks are counted.
BUCKET_ROWS = 500_000


@dataclass(frozen=True)
class Place:
    """Items of a length with ranks [first, last) go to the containers from `container` on, `each` to a container."""

    length: int
    first: int
    last: int
    container: int
    each: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Place], int]:
    """Best fit, longest first, over counts: the places and the number of containers. Lengths are 1 to capacity."""
    places: list[Place] = []
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> runs of containers (first, how many)
    spaces: list[int] = []  # the spaces left that have containers, ascending
    made = 0

    def keep(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append((first, many))

    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} with capacity {capacity}")
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, many = room[space].pop()
                if not room[space]:
                    del room[space]
                    spaces.pop(i)
            else:  # new containers, filled with this length as far as it goes
                space, first = capacity, made
                many = max(1, left // (capacity // length))
                made += many
            each = min(space // length, left)
            used = min(many, left // each)
            places.append(Place(length, rank, rank + used * each, first, each))
            keep(space - each * length, first, used)
            keep(space, first + used, many - used)
            left -= used * each
            rank += used * each
    return places, made


def items(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, capacity, doc_id, piece, start_token, length): a text that alone exceeds the capacity is cut into full pieces and a rest; others stay whole. Empty texts are left out;
    budgets without a positive capacity too."""
    good = budgets.filter("capacity_tokens > 0 AND budget_name IS NOT NULL").groupBy("budget_name").agg(F.min("capacity_tokens").alias("capacity")).collect()  # a table of fixed size
    each = F.explode(F.array(*[F.struct(F.lit(r["budget_name"]).alias("budget_name"), F.lit(r["capacity"]).alias("capacity")) for r in good])) if good else F.explode(F.expr("cast(array() as array<struct<budget_name: string, capacity: int>>)"))
    both = sizes.filter("tokens > 0").select("doc_id", "tokens", each.alias("b")).select("doc_id", "tokens", "b.*")
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, F.col("capacity").cast("bigint")))
    cut = both.select("budget_name", "capacity", "doc_id", "tokens", start.alias("start_token"))
    return cut.select(
        "budget_name", "capacity", "doc_id", F.floor(F.col("start_token") / F.col("capacity")).cast("int").alias("piece"), "start_token",
        F.least(F.col("capacity"), F.col("tokens") - F.col("start_token")).cast("int").alias("length"),
    )


def packed(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, capacity, container_id, doc_id, piece, start_token, length) for sizes (doc_id, tokens) and budgets (budget_name, capacity_tokens). Every token of every text is in
    exactly one container of each budget. Repeated doc_ids count as texts of their own."""
    spark = sizes.sparkSession
    all_ = items(sizes, budgets)
    counted = all_.groupBy("budget_name", "capacity", "length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the sum of capacities
    rows, total = [], 0
    for name, capacity in sorted({(r["budget_name"], r["capacity"]) for r in counted}):
        histogram = {r["length"]: r["n"] for r in counted if r["budget_name"] == name}
        total = max(total, sum(histogram.values()))
        rows += [(name, p.length, p.first, p.last, p.container, p.each) for p in plan(histogram, capacity)[0]]
    plans = spark.createDataFrame(rows, "budget_name string, length int, first bigint, last bigint, container bigint, each int")
    buckets = max(8, total // BUCKET_ROWS + 1)
    dealt = all_.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    # rank within the length: place in the bucket, after the buckets before it, so that no length is one task's
    within = Window.partitionBy("budget_name", "length", "bucket").orderBy("doc_id", "piece")
    sizes_ = dealt.groupBy("budget_name", "length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("budget_name", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes_.select("budget_name", "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = dealt.withColumn("rn", F.row_number().over(within)).join(offsets, ["budget_name", "length", "bucket"])
    ranked = placed.withColumn("rank", F.col("rn") - 1 + F.col("offset"))
    slots = F.broadcast(plans)  # a few rows for each length
    on = ["budget_name", "length"]
    hit = ranked.join(slots, on).filter("rank >= first AND rank < last")
    return hit.select("budget_name", "capacity", (F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("container_id"), "doc_id", "piece", "start_token", "length")


def containers(packed_: DataFrame) -> DataFrame:
    """(budget_name, container_id, texts, used_tokens, space_left) of each container."""
    one = packed_.groupBy("budget_name", "capacity", "container_id").agg(F.count(F.lit(1)).alias("texts"), F.sum("length").alias("used_tokens"))
    return one.select("budget_name", "container_id", "texts", "used_tokens", (F.col("capacity") - F.col("used_tokens")).alias("space_left"))


def report(packed_: DataFrame) -> DataFrame:
    """(budget_name, capacity, containers, least_possible, texts, cut_texts, tokens, space_left, filled_share) of each budget."""
    one = packed_.groupBy("budget_name", "capacity", "container_id").agg(F.count(F.lit(1)).alias("texts"), F.sum("length").alias("used"), F.sum((F.col("piece") == 1).cast("int")).alias("cut"))
    all_ = one.groupBy("budget_name", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("texts").alias("pieces"), F.sum("cut").alias("cut_texts"), F.sum("used").alias("tokens"))
    room = F.col("containers") * F.col("capacity")
    return all_.select("budget_name", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_possible"), "pieces", "cut_texts", "tokens", (room - F.col("tokens")).alias("space_left"), (F.col("tokens") / room).alias("filled_share"))
