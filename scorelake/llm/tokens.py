"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(path: str | None = None) -> str:
    """The vocabulary file: the argument, else $SCORELAKE_VOCABULARY, else the installed public one."""
    if path or os.environ.get("SCORELAKE_VOCABULARY"):
        return path or os.environ["SCORELAKE_VOCABULARY"]
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a ranks file, read once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(documents: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` columns of ``documents`` and ``n_tokens`` of the whole text; a null text has null tokens."""
    schema = documents.select(*keep).schema.add("n_tokens", T.IntegerType())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary_path(path)).encode_ordinary
        for batch in batches:
            sizes = pd.array([None if t is None else len(encode(t)) for t in batch["text"]], dtype="Int32")
            yield batch[keep].assign(n_tokens=sizes)

    return documents.select(*dict.fromkeys([*keep, "text"])).mapInPandas(count, schema)
