"""Which chunks lack a vector of which model, and making them. The model itself is the caller's: a function from (id, text) to (id, vector)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import search

#: Models by alias: full name, dimensions, and what is put before a query (fixed values).
MODELS = {
    "fast": ("sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", 384, ""),
    "balanced": ("intfloat/multilingual-e5-large", 1024, ""),
    "quality": ("mixedbread-ai/mxbai-embed-large-v1", 1024, "Represent this sentence for searching relevant passages: "),
    "hash": ("quire/hashed-words", 64, ""),
}


def model(name: str) -> tuple[str, int, str]:
    """(full name, dimensions, query prefix) of an alias, a full name, or a full name without what stands before its slash; an unknown name stays as it is, with dimensions -1."""
    if name in MODELS:
        return MODELS[name]
    return next((m for m in MODELS.values() if m[0] == name or ("/" not in name and m[0].endswith("/" + name))), (name, -1, ""))


def as_query(text: str, name: str) -> str:
    """A query as its model wants it."""
    return model(name)[2] + text


def lacking(chunks: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    """Chunks (chunk_id, content) without a vector (chunk_id, model, vector) of this model."""
    have = vectors.select("chunk_id", "model")
    return chunks.dropDuplicates(["chunk_id"]).withColumn("model", F.lit(model(name)[0])).join(have, ["chunk_id", "model"], "left_anti")


def stats(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(model, vectors, percent): for each model how many chunks have a vector, and what share that is; vectors of chunks that are gone do not count."""
    ids = chunks.select("chunk_id").distinct()
    held = vectors.select("chunk_id", "model").distinct().join(ids, "chunk_id", "left_semi").groupBy("model").agg(F.count(F.lit(1)).alias("vectors"))
    return held.join(F.broadcast(ids.agg(F.count(F.lit(1)).alias("_n"))), how="inner").select("model", "vectors", F.round(100.0 * F.col("vectors") / F.col("_n"), 6).alias("percent"))


def generated(chunks: DataFrame, vectors: DataFrame, name: str, embed: Callable[[DataFrame], DataFrame] = search.embedded, force: bool = False, only: DataFrame | None = None) -> DataFrame:
    """vectors (chunk_id, model, vector) with those that were lacking. With force all are made anew. Vectors of another model are a mistake unless force says that they go: two models' vectors cannot
    be compared. only (chunk_id): just these, if they still exist; done again, nothing changes. Texts go to the model in batches."""
    full = model(name)[0]
    others = [r["model"] for r in vectors.select("model").distinct().limit(100).collect() if r["model"] != full]
    if others and not force:
        raise ValueError(f"there are vectors of {', '.join(sorted(others))}; force makes all anew with {full}")
    kept = vectors.filter(F.lit(not force))
    todo = lacking(chunks, kept, name)
    if only is not None:
        todo = todo.join(only.select("chunk_id").distinct(), "chunk_id", "left_semi")
        kept = vectors if not force else vectors.filter(F.col("model") == full).join(only.select("chunk_id"), "chunk_id", "left_anti")
    ask = todo.filter("content IS NOT NULL").select(F.xxhash64("chunk_id").alias("id"), F.col("content").alias("text"), "chunk_id")
    made = embed(ask.select("id", "text")).join(ask.select("id", "chunk_id"), "id")
    return kept.select("chunk_id", "model", "vector").unionByName(made.select("chunk_id", F.lit(full).alias("model"), "vector"))
