"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's vocabulary, as ranks. The driver reads it; executors get its bytes.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that tokenizer cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, tiktoken.Encoding] = {}


def encoder(data: bytes) -> tiktoken.Encoding:
    """The tokenizer with this vocabulary, made once in each process."""
    key = hash(data)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_counts(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the size of the whole text; null for a null text, 0 for an empty one."""
    shared = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*keep).schema)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(shared.value)
        for batch in batches:
            sizes = [None if t is None else len(enc.encode_ordinary(t)) for t in batch["text"]]
            yield batch[keep].assign(tokens=pd.array(sizes, "Int64"))

    return documents.select(*keep, F.col("text")).mapInPandas(count, f"{fields}, tokens long")
