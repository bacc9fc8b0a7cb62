"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import spread, written

#: Default of the path parameter: a byte-level BPE vocabulary as ranks, a base64 token and its rank on each line.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's tokenizer cuts text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoder(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, path: str = RANKS) -> DataFrame:
    """texts (id, text, others...) with the number of tokens instead of the text; 0 for a null or empty text. Written, because counting is the dearest step."""
    rest = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            yield b[rest].assign(tokens=[len(e.encode_ordinary(t)) if t else 0 for t in b["text"]])

    schema = ", ".join([*(f"`{n}` {k}" for n, k in texts.dtypes if n != "text"), "tokens bigint"])
    return written(spread(texts.select(*rest, "text")).mapInPandas(run, schema))


def document_tokens(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, source, tokens) of documents; source without regard to case and blanks around it, null where blank."""
    source = F.nullif(F.lower(F.trim("source")), F.lit(""))
    return token_counts(documents.filter("doc_id IS NOT NULL").select("doc_id", source.alias("source"), "text"), path)
