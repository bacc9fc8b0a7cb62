"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Intervals of whole days are cut into canonical dyadic blocks (level k, index i: the days [i * 2^k, (i + 1) * 2^k)). Equal blocks of an entity
collapse in the map-side aggregate, so that whatever a hot entity sends on is bounded by the calendar (at most two blocks a day), not by its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days from 0001-01-01 to 1970-01-01.
EPOCH = 719162
#: 2^22 days reach beyond year 9999.
BITS = 22


def dyadic_blocks(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, code, n): the canonical blocks of the intervals [start, end), given in days from 0001-01-01, each with its number of intervals.
    code is first day * 64 + level. At level k the blocks are those at ceil(start / 2^k), if odd, and at floor(end / 2^k) - 1, if even."""
    blocks = f"""
      inline(filter(flatten(transform(sequence(0, int(floor(log2({end} - {start})))), k -> array(
        struct(k AS lvl, shiftright({start} + shiftleft(1, k) - 1, k) AS idx, shiftright({start} + shiftleft(1, k) - 1, k) % 2 = 1
               AND shiftright({start} + shiftleft(1, k) - 1, k) < shiftright({end}, k) AS ok),
        struct(k AS lvl, shiftright({end}, k) - 1 AS idx, shiftright({end}, k) % 2 = 1
               AND shiftright({start} + shiftleft(1, k) - 1, k) < shiftright({end}, k) AS ok)))), b -> b.ok))"""
    flat = df.filter(f"{start} < {end}").selectExpr(entity, blocks)
    code = F.shiftleft(F.col("idx").cast("long"), 6) * F.expr("shiftleft(1L, lvl)") + F.col("lvl")
    return flat.select(entity, code.alias("code")).groupBy(entity, "code").agg(F.count(F.lit(1)).alias("n"))


def _runs(g: np.ndarray, code: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, ...]:
    """Periods of groups g from their blocks: group, first day, day after the last, and whether two intervals meet on some day."""
    lvl, start = code & 63, code >> 6
    order = np.lexsort((-lvl, start, g))
    g, start, lvl, twice = g[order], start[order], lvl[order], twice[order]
    base = g << 32
    end = base + start + (np.int64(1) << lvl)
    reach = np.maximum.accumulate(end)
    covered = np.zeros(len(g), bool)
    covered[1:] = reach[:-1] >= end[1:]  # blocks nest or are apart: a block reached by an earlier one lies inside an ancestor
    twice = twice | covered
    at, marks = (base + start)[~covered], (base + start)[twice]
    size = lvl[~covered]
    for k in range(BITS):  # sibling pairs become their parent
        if len(at) < 2:
            break
        pair = (size[:-1] == k) & (size[1:] == k) & (at[1:] - at[:-1] == (1 << k)) & (((at[:-1] & 0xFFFFFFFF) >> k) % 2 == 0)
        i = np.flatnonzero(pair)
        if len(i):
            size[i] = k + 1
            keep = np.ones(len(at), bool)
            keep[i + 1] = False
            at, size = at[keep], size[keep]
    stop = at + (np.int64(1) << size)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] > stop[:-1]
    head = np.flatnonzero(first)
    last = np.append(head[1:], len(at)) - 1
    meets = np.zeros(len(head), bool)
    meets[np.searchsorted(at[head], marks, side="right") - 1] = True
    return at[head] >> 32, at[head] & 0xFFFFFFFF, stop[last] & 0xFFFFFFFF, meets


def _periods(entity: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sizes = b["blocks"].map(len).to_numpy()
            flat = np.concatenate(b["blocks"].to_numpy()).astype(np.int64)
            g, a, z, meets = _runs(np.repeat(np.arange(len(b), dtype=np.int64), sizes), flat >> 1, (flat & 1) == 1)
            after = np.zeros(len(g), np.int64)
            after[:-1] = np.where(g[1:] == g[:-1], a[1:], 0)
            yield pd.DataFrame({entity: b[entity].to_numpy()[g], "first_day": a, "after_last": z, "overlaps": meets, "next_day": after})

    return run


def periods(df: DataFrame, entity: str, first: str, last: str, open_year: int = 2900) -> DataFrame:
    """(entity, first_day, after_last, overlaps, next_day): the maximal runs of days covered by the rows of one entity. Days are numbers from
    0001-01-01; after_last is 2^22 where the period has no end; next_day is the first day of the following period, or 0.

    Both dates are inclusive. A null `last`, or one in open_year or later, means no end. Rows with a null entity, a null `first` or a `last` before
    `first` are left out; an empty table gives no rows; repeated rows overlap (remove repeated records before)."""
    day = lambda c: F.greatest(F.unix_date(F.col(c)) + EPOCH, F.lit(0))
    stop = F.when(F.col(last).isNull() | (F.year(last) >= open_year), F.lit(1 << BITS)).otherwise(day(last) + 1)
    good = df.filter(F.col(entity).isNotNull() & F.col(first).isNotNull() & (F.col(last).isNull() | (F.col(last) >= F.col(first))))
    spans = good.select(F.col(entity), day(first).alias("_a"), stop.cast("int").alias("_z"))
    packed = F.shiftleft(F.col("code"), 1) + (F.col("n") > 1).cast("long")
    grouped = dyadic_blocks(spans, entity, "_a", "_z").groupBy(entity).agg(F.collect_list(packed).alias("blocks"))
    kind = dict(df.dtypes)[entity]
    return grouped.mapInPandas(_periods(entity), f"{entity} {kind}, first_day bigint, after_last bigint, overlaps boolean, next_day bigint")


def day_text(day) -> F.Column:
    return F.date_format(F.date_from_unix_date((day - EPOCH).cast("int")), "yyyy-MM-dd")


def overlaps_and_gaps(found: DataFrame, entity: str) -> DataFrame:
    """(entity, kind, start_day, end_day) of periods(): `merged` periods, in which intervals meet, and the `gap` after each but the last."""
    row = lambda kind, a, z: F.struct(F.lit(kind).alias("kind"), a.alias("start_day"), z.alias("end_day"))
    end = F.when(F.col("after_last") >= (1 << BITS), F.lit("open")).otherwise(day_text(F.col("after_last") - 1))
    rows = F.array(
        F.when(F.col("overlaps"), row("merged", day_text(F.col("first_day")), end)),
        F.when(F.col("next_day") > 0, row("gap", day_text(F.col("after_last")), day_text(F.col("next_day") - 1))),
    )
    return found.select(entity, F.explode(F.array_compact(rows)).alias("r")).select(entity, "r.*")
