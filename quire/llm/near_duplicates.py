"""Near-duplicate texts: pairs and groups whose sets of word runs overlap beyond a threshold.

Every text gets min-hashes of its runs of words. Texts that agree in all rows of a band of min-hashes share a shard; a text is in the shards of all its bands, so that shards overlap. In a
shard, a vantage-point tree over 64-bit fingerprints (a bit of each of 64 min-hashes: the Hamming distance of two texts is near 32 * (1 - similarity)) finds the texts within reach, with branches
pruned by triangle bounds. Shards too large for one tree are cut into cells around vantage points; a text is a point of its nearest cell and a query of all cells its reach touches. The
pairs are then checked exactly, on the sets of word runs. Texts with the same words are one class throughout.

Why bands come first: unrelated texts all lie 32 +- 4 bits apart, a wanted pair up to 27, so that over a whole collection no vantage point could prune a branch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.vptree import Tree, close_pairs, distance
from quire.llm.words import mixed, shingles
from quire.operators.skew import join_unique
from quire.session import spread, written

BITS = 64
#: Texts of a shard that go into one tree; larger shards are cut into cells.
SHARD = 4096
CELLS = 32


@dataclass(frozen=True)
class Settings:
    """similarity: least Jaccard similarity of the sets of runs of `run` words, of texts with at least least_words words. A pair at the threshold is
    missed by all bands with probability (1 - similarity^rows)^bands."""

    run: int = 5
    similarity: float = 0.8
    least_words: int = 0
    bands: int = 16
    rows: int = 4
    seed: int = 11

    @property
    def reach(self) -> int:
        """Hamming distance that a pair at the threshold exceeds with a probability below 0.00002."""
        p = (1 - self.similarity) / 2
        return math.ceil(BITS * p + 4.2 * math.sqrt(BITS * p * (1 - p)))


def _minhashes(s: np.ndarray, lengths: np.ndarray, k: int, seed: int) -> np.ndarray:
    """(texts with runs, k) min-hashes."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)
    sizes = lengths[lengths > 0]
    out = np.empty((len(sizes), k), np.uint32)
    low = (s >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    step = 0
    while step < len(sizes):  # blocks that stay in the cache
        last = int(np.searchsorted(starts, starts[step] + 60_000, side="right"))
        last = min(max(last - 1, step + 1), len(sizes))
        part, at = low[starts[step] : starts[last]], starts[step:last] - starts[step]
        for j in range(k):
            out[step:last, j] = np.minimum.reduceat(part * a[j] + b[j], at)
        step = last
    return out


def _signatures(o: Settings):
    k = max(o.bands * o.rows, BITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s, lengths = shingles(b["text"].tolist(), o.run, o.least_words)
            has = lengths > 0
            if not has.any():
                continue
            m = _minhashes(s, lengths, k, o.seed)
            keys = np.zeros((len(m), o.bands), np.uint64)
            for i in range(o.bands):
                x = np.full(len(m), i + 1, np.uint64)
                for r in range(o.rows):
                    x = mixed(x * np.uint64(31) + m[:, i * o.rows + r])
                keys[:, i] = x
            bits = (mixed(m[:, :BITS].astype(np.uint64)) & np.uint64(1)) << np.arange(BITS, dtype=np.uint64)
            points = np.bitwise_or.reduce(bits, axis=1)
            yield pd.DataFrame({"id": b["id"].to_numpy()[has], "c1": b["c1"].to_numpy()[has], "c2": b["c2"].to_numpy()[has], "bands": list(keys.view(np.int64)), "point": points.view(np.int64)})

    return run


def _shards(reach: int):
    """From rows sorted by shard: candidate pairs (kind 0), and the rows of shards that are too large (kind 1)."""
    none = np.zeros(0, np.int64)

    def pairs(ids: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [none], [none]
        for size in np.unique(sizes):
            own = starts[sizes == size]
            if size <= 24:  # one leaf each: all shards of this size at once
                i, j = np.triu_indices(size, 1)
                x, y = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
                keep = distance(points[x], points[y]) <= reach
                left.append(ids[x[keep]])
                right.append(ids[y[keep]])
            else:
                for at in own:
                    x, y = close_pairs(points[at : at + size], reach)
                    left.append(ids[at + x])
                    right.append(ids[at + y])
        return np.concatenate(left), np.concatenate(right)

    def frame(kind: int, a: np.ndarray, b: np.ndarray, point: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "a": a, "b": b, "point": point})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, large = None, None  # the last shard of a batch may go on; large: a shard already known to be too large
        for b in _ended(batches):
            if b is not None:
                cols = [b[c].to_numpy() for c in ("shard", "id", "point")]
                if rest is not None:
                    cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            elif rest is not None:
                cols = rest
            else:
                return
            shard, ids, points = cols
            if not len(shard):
                continue
            if large is not None:
                own = shard == large
                if own.any():
                    yield frame(1, shard[own], ids[own], points[own])
                    shard, ids, points = shard[~own], ids[~own], points[~own]
                if len(shard):
                    large = None
                else:
                    rest = None
                    continue
            starts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1])
            sizes = np.diff(np.append(starts, len(shard)))
            if b is not None:  # keep the last shard back
                if sizes[-1] > SHARD:
                    large, rest = shard[-1], None
                    yield frame(1, shard[starts[-1] :], ids[starts[-1] :], points[starts[-1] :])
                else:
                    rest = [c[starts[-1] :].copy() for c in (shard, ids, points)]
                starts, sizes = starts[:-1], sizes[:-1]
            for at, size in zip(starts[sizes > SHARD], sizes[sizes > SHARD], strict=True):
                z = slice(at, at + size)
                yield frame(1, shard[z], ids[z], points[z])
            some = (sizes > 1) & (sizes <= SHARD)
            x, y = pairs(ids, points, starts[some], sizes[some])
            if len(x):
                yield frame(0, np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), np.int64)).drop_duplicates()

    return run


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _cells(reach: int):
    """For each row of a large shard: itself as a point of its nearest cell, and as a query of the cells that its reach touches: with the nearest vantage
    point at d, a point within reach can only be in cells whose vantage point is at d + 2 * reach or less."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for shard, own in b.groupby("a", sort=False):
                vantage = np.asarray(own["vantage"].iloc[0], dtype=np.int64).view(np.uint64)
                d = distance(own["point"].to_numpy().view(np.uint64)[:, None], vantage[None, :])
                home = d.argmin(axis=1)
                near = d.min(axis=1)
                q, c = np.nonzero(d <= (near + 2 * reach)[:, None])
                ids, points = own["b"].to_numpy(), own["point"].to_numpy()
                out.append(pd.DataFrame({"shard": shard, "cell": home.astype(np.int32), "role": np.int32(0), "id": ids, "point": points}))
                out.append(pd.DataFrame({"shard": shard, "cell": c.astype(np.int32), "role": np.int32(1), "id": ids[q], "point": points[q]}))
            if out:
                yield pd.concat(out)

    return run


def _search_cells(reach: int):
    """From rows sorted by shard, cell and role: a tree over a cell's points, then its queries, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, points, tree = None, [], [], None
        for b in batches:
            for k, own in b.groupby(["shard", "cell"], sort=False):
                if k != key:
                    key, ids, points, tree = k, [], [], None
                role = own["role"].to_numpy()
                if (role == 0).any():
                    ids.append(own["id"].to_numpy()[role == 0])
                    points.append(own["point"].to_numpy()[role == 0].view(np.uint64))
                if (role == 1).any() and points:
                    if tree is None:
                        all_ids, tree = np.concatenate(ids), Tree(np.concatenate(points))
                    who = own["id"].to_numpy()[role == 1]
                    for q, p in tree.within(own["point"].to_numpy()[role == 1].view(np.uint64), reach):
                        a, z = who[q], all_ids[p]
                        keep = a != z
                        if keep.any():
                            yield pd.DataFrame({"a": np.minimum(a, z)[keep], "b": np.maximum(a, z)[keep]}).drop_duplicates()

    return run


def _candidates(classes: DataFrame, o: Settings) -> DataFrame:
    shards = classes.select(F.explode("bands").alias("shard"), "id", "point")
    found = written(shards.repartition("shard").sortWithinPartitions("shard").mapInPandas(_shards(o.reach), "kind int, a bigint, b bigint, point bigint"))
    pairs = found.filter("kind = 0").select("a", "b")
    large = found.filter("kind = 1").select("a", "b", "point")
    if large.isEmpty():
        return pairs.distinct()
    counts = large.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    some = large.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(CELLS)).alias("k")).agg(F.min_by("point", "b").alias("point"))
    vantage = some.groupBy("a").agg(F.array_sort(F.collect_set("point")).alias("vantage"))
    cells = join_unique(large, vantage, ["a"], counts, "n").mapInPandas(_cells(o.reach), "shard bigint, cell int, role int, id bigint, point bigint")
    more = cells.repartition("shard", "cell").sortWithinPartitions("shard", "cell", "role").mapInPandas(_search_cells(o.reach), "a bigint, b bigint")
    return pairs.unionByName(more).distinct()


#: Least and most bits of the filter that tells which texts take part in a pair.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bitmap over hashed ids, of eight bits or more for each up to MOST_BITS, which are 16 MB; other texts may pass it now and then, which costs time but changes nothing."""
    n = ids.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n).bit_length()))
    h = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.floor(h / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for part in words.toLocalIterator() if n > 1_000_000 else [words.toPandas()]:
        if isinstance(part, pd.DataFrame):
            out[part["w"].to_numpy(np.int64)] = part["bits"].to_numpy(np.int64)
        else:
            out[part["w"]] = part["bits"]
    return out.view(np.uint64)


def _sets(o: Settings, bitmap):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = bitmap.value
        for b in batches:
            h = b["h"].to_numpy().view(np.uint64) % np.uint64(len(bits) * 64)
            b = b[(bits[h // np.uint64(64)] >> (h % np.uint64(64))) & np.uint64(1) == 1]
            s, lengths = shingles(b["text"].tolist(), o.run, o.least_words)
            at = np.concatenate([[0], np.cumsum(lengths)])
            yield pd.DataFrame({"id": b["id"].to_numpy(), "runs": pd.Series([np.unique(s[at[i] : at[i + 1]]).view(np.int64) for i in range(len(b))], dtype=object)})

    return run


def _words_at_least(text: Column, n: int) -> Column:
    """Whether a text has n words; long texts tell by their beginning, all others are counted whole."""
    count = lambda t: F.size(F.array_remove(F.split(t, r"[^\p{L}\p{N}]+"), ""))
    return F.when(F.length(text) < 2 * n - 1, False).when(count(F.substring(text, 1, 16 * n)) > n, True).otherwise(count(text) >= n)


def similar_pairs(texts: DataFrame, o: Settings) -> tuple[DataFrame, DataFrame]:
    """Of texts (id, text), rows with equal id being one text: the pairs (a, b, similarity) of class representatives that reach the similarity, a < b, and the members (id, representative,
    copies) of every class. A class holds equal texts, `copies` of them; its representative is the smallest id. Texts with too few words, null ones included, are in neither. An empty table gives none."""
    spark = texts.sparkSession
    known = spread(texts.filter("id IS NOT NULL AND text IS NOT NULL").select("id", "text")).select("id", "text", F.xxhash64("text").alias("c1"), F.xxhash64(F.lit(1), "text").alias("c2"))
    signed = known.mapInPandas(_signatures(o), "id bigint, c1 bigint, c2 bigint, bands array<bigint>, point bigint")
    classes = signed.groupBy("c1", "c2").agg(F.min_by(F.struct("id", "bands", "point"), "id").alias("r")).select("r.*")
    candidates = written(_candidates(classes, o))
    takes = candidates.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    bitmap = spark.sparkContext.broadcast(_filter_of(takes.select("id")))  # 16 MB at most
    hashed = known.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(MOST_BITS)).alias("h"))
    sets = written(hashed.mapInPandas(_sets(o, bitmap), "id bigint, runs array<bigint>").dropDuplicates(["id"]))  # both sides of each pair
    both = candidates
    for c in "ab":  # a text may be in very many pairs
        side = sets.select(F.col("id").alias(c), F.col("runs").alias(f"runs_{c}"))
        both = join_unique(both, side, [c], candidates.groupBy(c).agg(F.count(F.lit(1)).alias("n")), "n", by=["a", "b"])
    common = F.size(F.array_intersect("runs_a", "runs_b"))
    similarity = common / (F.size("runs_a") + F.size("runs_b") - common)
    pairs = both.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= o.similarity)
    long = written(known.filter(_words_at_least(F.col("text"), max(o.run, o.least_words))).select("id", "c1", "c2").distinct())
    heads = written(long.groupBy("c1", "c2").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("copies")))
    members = join_unique(long, heads, ["c1", "c2"], heads.select("c1", "c2", "copies"), "copies").select("id", "representative", "copies")
    return pairs, members


#: Members of a class that meet those of another, or of the same, in one task.
BLOCK = 1024


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of texts, those of equal ones included. Classes of more than BLOCK members are dealt into blocks, and pairs of blocks over the tasks."""
    blocks = F.ceil(F.col("copies") / BLOCK).cast("int")
    dealt = members.select("representative", "id", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    side = lambda c: dealt.select(F.col("representative").alias(c), F.col("block").alias(f"block_{c}"), F.col("id").alias(f"id_{c}"))
    heads = members.filter("id = representative").select("representative", blocks.alias("blocks"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    across = pairs.select("a", "b")
    for c in "ab":
        sized = heads.select(F.col("representative").alias(c), "blocks")
        across = across.join(sized, c).withColumn(f"block_{c}", upto("blocks")).drop("blocks")
    across = across.join(side("a"), ["a", "block_a"]).join(side("b"), ["b", "block_b"]).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    copied = members.filter("id = representative AND copies > 1").select(F.col("representative").alias("a"), F.col("representative").alias("b"), blocks.alias("blocks"))
    within = copied.withColumn("block_a", upto("blocks")).withColumn("block_b", F.explode(F.sequence(F.col("block_a"), F.col("blocks") - 1)))
    within = within.join(side("a"), ["a", "block_a"]).join(side("b"), ["b", "block_b"]).filter("id_a <> id_b AND (block_a < block_b OR id_a < id_b)")
    return across.unionByName(within.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")))


def groups(pairs: DataFrame, members: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, group_id, links): for each text that is alike another, the smallest id of its connected group, and to how many other texts of different content it is linked.

    Alternating stars: each round, every text's larger neighbours, then its smaller ones, are linked to the smallest id around; rounds end when no link changes, after about the logarithm of
    the longest chain. Each round's links are written to the shared folder. A text with very many links is dealt over many tasks."""
    links = written(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges, before = links, None
    for _ in range(most_rounds):
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = written(join_unique(around, least.drop("n"), ["u"], least.select("u", "n"), "n", by=["u", "v"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        met = join_unique(large, least.drop("n"), ["u"], least.select("u", "n"), "n", by=["u", "v"])
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after = written(small)
        # a sum of hashes tells sets of links apart
        state = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        edges = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"groups did not settle in {most_rounds} rounds")
    heads = edges.groupBy("u").agg(F.min("v").alias("group_id"))
    degree = links.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    # of each class one row, then its members: a class with very many is dealt over many tasks
    one = members.filter("id = representative").select(F.col("representative").alias("u"), "copies").join(heads, "u", "left").join(degree, "u", "left").filter("degree IS NOT NULL OR copies > 1")
    one = written(one.select(F.col("u").alias("representative"), F.coalesce("group_id", "u").alias("group_id"), F.coalesce("degree", F.lit(0)).alias("links"), "copies"))
    return join_unique(members.select("id", "representative"), one.drop("copies"), ["representative"], one.select("representative", "copies"), "copies", by=["id"]).select("id", "group_id", "links")
