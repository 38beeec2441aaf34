"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.operators.arrowtools import arrow_schema, map_arrow, text_array

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pre-tokenization pattern that belongs to the byte-level vocabulary of 50k entries.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | None, path: str = VOCABULARY) -> int:
    """0 for null and empty texts; what looks like a special token is ordinary text."""
    return len(_encoding(path).encode_ordinary(text)) if text else 0


def text_tokens(text: str | None, path: str = VOCABULARY) -> list[bytes]:
    """The bytes of each token of a text; together they are the text."""
    if not text:
        return []
    encoding = _encoding(path)
    return [encoding.decode_single_token_bytes(t) for t in encoding.encode_ordinary(text)]


def with_token_count(df: DataFrame, keep: list[str], text: str, name: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """`keep` and the number of tokens of the whole text. No shuffle."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.LongType())])
    target = arrow_schema(schema)

    def count(batch: pa.RecordBatch):
        sizes = [token_count(t, path) for t in text_array(batch.column(len(keep))).to_pylist()]
        yield from pa.table([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=target.names).cast(target).to_batches()

    return map_arrow(df.select(*keep, F.col(text).cast("string").alias("_text")), count, schema)
