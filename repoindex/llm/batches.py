"""Arrow batches of whole texts as flat numpy arrays; the helpers the Python-side operators share.

Texts arrive in Arrow batches and are worked on in blocks of a few megabytes, so a task holds one block, not a
partition. A text is never cut: one longer than a block is a block by itself.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type

from repoindex.session import scratch_path

BLOCK_BYTES = 4 << 20
MADE = "_made_in_python"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
SPARKS_BATCH, BATCH = "67108864b", "8m"

# The white space that ends a word, as bytes.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    return table


NOT_SPACE = ~byte_table(SPACE_BYTES)


def flat_text(texts: pa.Array, end: str = "") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each begins; null is the empty text.

    ``end`` is put after every text, so that no run of word bytes crosses into the next text.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if end:
        texts = pc.binary_join_element_wise(texts, pa.scalar(end, pa.large_string()), pa.scalar("", pa.large_string()))
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first, last = int(bounds[0]), int(bounds[-1])
    flat = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return flat, bounds - first


def word_bounds(flat: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes."""
    inside = np.zeros(len(flat) + 2, dtype=np.int8)
    inside[1:-1] = is_word[flat]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def coded_words(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> pa.DictionaryArray:
    """The words as a dictionary array: equal words, and only those, have equal codes."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    packed = flat[is_word[flat]]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one text at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    totals = np.cumsum(sizes, dtype=np.int64)
    row = 0
    while row < len(sizes):
        before = int(totals[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(totals, before + limit, side="right")))
        yield batch.slice(row, stop - row)
        row = stop


def ragged_take(values: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``picks`` of a ragged array, laid end to end, and where each begins."""
    lengths = (offsets[1:] - offsets[:-1])[picks]
    bounds = np.zeros(len(picks) + 1, dtype=np.int64)
    np.cumsum(lengths, out=bounds[1:])
    return values[np.repeat(offsets[picks] - bounds[:-1], lengths) + np.arange(bounds[-1])], bounds


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame without columns of these names, however they are written."""
    taken = {name.lower() for name in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and there for tasks that are run again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on Arrow batches of the session hold 8 MB instead of 64, unless it names a size itself.

    A task has several batches of input and output at a time, on either side of the socket.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, SPARKS_BATCH) == SPARKS_BATCH:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH)
    return df


def add_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField],
                make: Callable[[list[pa.Array]], list[pa.Array]], limit: int = BLOCK_BYTES) -> DataFrame:
    """Append columns that ``make`` computes from the input columns, block by block; the first input is the text.

    Only the inputs go to Python and only the new columns come back; all others stay where they are. Columns that
    already have one of the new names are replaced.
    """
    kind = to_arrow_type(T.StructType(fields))

    def run(*columns: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays(list(columns), [str(n) for n in range(len(columns))])
        parts = [pa.StructArray.from_arrays(
            [c if c.type == f.type else c.cast(f.type) for c, f in zip(make(part.columns), kind, strict=True)],
            fields=list(kind)) for part in blocks(whole, 0, limit)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    # Not deterministic in the optimizer's sense: it is then computed once, however often its fields are used.
    made = F.arrow_udf(run, T.StructType(fields), ArrowUDFType.SCALAR).asNondeterministic()
    new = {field.name.lower() for field in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    found = bound_batches(df).withColumn(MADE, made(*[F.col(f"`{c}`") for c in inputs]))
    return found.select(*[F.col(f"`{c}`") for c in kept], *[F.col(MADE)[f.name].alias(f.name) for f in fields])
