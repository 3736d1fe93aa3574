"""Embedding backends: any Python callable, or a hashed bag of words that needs no model."""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.functions.tokens import token_parts, tokens
from repoindex.schemas import EMBEDDING_DIM

# Fixed value: texts per backend call.
EMBED_BATCH = 64

EmbedFn = Callable[[list[str], str], list[list[float]]]


def _bucket(token: str, dim: int) -> int:
    return int.from_bytes(hashlib.md5(token.encode(), usedforsecurity=False).digest()[:4]) % dim


def hashed_bag(words: Column, dim: int) -> Column:
    """L2-normalised counts of token hashes; a text without tokens gives the zero vector."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def bag(lists: pa.Array) -> pa.Array:
        rows = len(lists)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        buckets = np.array([_bucket(w, dim) for w in coded.dictionary.to_pylist()], dtype=np.int64)
        indices = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.zeros((rows, dim), dtype=np.int64)
        for part, held in token_parts(lengths):
            cells = np.repeat(np.arange(part.stop - part.start, dtype=np.int64), lengths[part]) * dim
            if len(cells):
                cells += buckets[indices[held]]
            counts[part] = np.bincount(cells, minlength=(part.stop - part.start) * dim).reshape(-1, dim)
        norms = np.sqrt((counts * counts).sum(axis=1))
        vectors = counts / np.where(norms == 0, 1.0, norms)[:, None]
        offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(vectors.astype(np.float32).ravel()))

    return bag(words)


def hash_embed(text: Column, dim: int = EMBEDDING_DIM) -> Column:
    return hashed_bag(tokens(text), dim)


def _call_backend(backend: EmbedFn, texts: list[str], mode: str, dim: int) -> list[list[float]]:
    answer = backend(texts, mode)
    if len(answer) != len(texts) or any(len(v) != dim for v in answer):
        raise ValueError(f"the embedding backend must return {dim} numbers for each text")
    return answer


def _call_singly(backend: EmbedFn, texts: list[str], mode: str, dim: int) -> list[list[float] | None]:
    """Text by text, None where the backend fails, so that one bad text spoils no other."""
    out = []
    for text in texts:
        try:
            out += _call_backend(backend, [text], mode, dim)
        except Exception:
            out.append(None)
    return out


def backend_udf(fn: EmbedFn | None, loader: Callable[[], EmbedFn] | None, mode: str, batch: int, dim: int,
                null_on_error: bool):
    """Call a backend with at most ``batch`` texts at a time; ``loader`` makes it once per task."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        backend = loader() if loader else fn
        for texts in batches:
            vectors = []
            for start in range(0, len(texts), batch):
                part = texts.slice(start, batch).to_pylist()
                try:
                    vectors += _call_backend(backend, part, mode, dim)
                except Exception:
                    if not null_on_error:
                        raise
                    vectors += _call_singly(backend, part, mode, dim)
            yield pa.array(vectors, pa.list_(pa.float32()))

    return call


def embed(
    df: DataFrame,
    text_col: str,
    fn: EmbedFn | None = None,
    *,
    loader: Callable[[], EmbedFn] | None = None,
    mode: str = "document",
    batch: int = EMBED_BATCH,
    dim: int = EMBEDDING_DIM,
    null_on_error: bool = False,
) -> DataFrame:
    """Add ``embedding`` to a table of texts. Without a backend the hashed bag of words is used.

    A failing backend fails the job, or with ``null_on_error`` leaves NULL for the texts it fails on.
    """
    if mode not in ("document", "query"):
        raise ValueError(f"unknown embedding mode: {mode}")
    if fn is None and loader is None:
        return df.withColumn("embedding", hash_embed(F.col(text_col), dim))
    return df.withColumn("embedding", backend_udf(fn, loader, mode, batch, dim, null_on_error)(F.col(text_col)))
