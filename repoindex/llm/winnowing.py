"""Winnowing fingerprints: of every window of neighbouring k-gram hashes the smallest, with its position.

A text's k-grams of code points are hashed by a rolling polynomial, all texts of a block in one pass; every window of
neighbouring hashes gives its smallest, the rightmost of equal ones. Texts that share a run of at least
``gram + window - 1`` code points therefore share a hash, and its positions say where the run is. A text of fewer
code points than a gram is one gram, and one of fewer grams than a window is one window; an empty text has no
fingerprint. Equal texts have equal fingerprints, and likeness is the Jaccard index of the hashes.

The second half of the module holds documents against their successors in a total order, each against a text edited with
the successor's beginning. Texts move once, to tasks that hold a range of the order and read it as a stream.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.llm.batches import add_columns, blocks, bound_batches, flat_text, ragged_take
from repoindex.llm.text_stats import IS_LEAD

GRAM = 16
WINDOW = 64
# Bytes of text whose hashes are made at a time; a code point takes about a hundred bytes of arrays.
BLOCK_BYTES = 1 << 20
# Ranges of the order; their first ids are a list that every task gets.
MAX_RANGES = 20_000
# An odd multiplier of the polynomial, its inverse modulo 2^64, and the constants that mix its bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

FIELDS = [T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("positions", T.ArrayType(T.IntegerType()))]


# ---- fingerprints of a block of texts ----

def code_points(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts laid end to end, and where each text begins."""
    points = np.frombuffer(flat.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.append(0, np.cumsum(IS_LEAD[flat], dtype=np.int64))[bounds]


def _mixed(values: np.ndarray) -> np.ndarray:
    for constant in MIX:
        values = (values ^ (values >> np.uint64(33))) * np.uint64(constant)
    return values ^ (values >> np.uint64(33))


def rolling_hashes(points: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the grams that begin at these places and have these lengths, from sums that every gram shares.

    With s(i) the sum of c[j] * base^-j over j < i, a gram from i to e hashes to (s(e) - s(i)) * base^(e-1), which is its
    polynomial wherever it stands; its length goes in too.
    """
    with np.errstate(over="ignore"):
        size = len(points) + 1
        powers = np.cumprod(np.append(np.uint64(1), np.full(size - 1, BASE, np.uint64)))
        inverses = np.cumprod(np.append(np.uint64(1), np.full(size - 1, INVERSE, np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * inverses[:-1]))
        ends = begins + lengths
        found = (sums[ends] - sums[begins]) * powers[np.maximum(ends - 1, 0)]
        return _mixed(found + lengths.astype(np.uint64))


def window_minima(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash of each window of neighbours and its place, the rightmost of equal ones; by doubling widths."""
    value, place, width = hashes, np.arange(len(hashes)), 1
    while width < window:
        step = min(width, window - width)
        right = value[step:] <= value[:-step]
        value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
        width += step
    return value, place


def winnow(points: np.ndarray, bounds: np.ndarray, gram: int = GRAM, window: int = WINDOW
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen hashes, their positions in their texts, and where each text's begin."""
    lengths = np.diff(bounds)
    grams = np.where(lengths > 0, np.maximum(lengths - gram + 1, 1), 0)
    if not grams.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(lengths) + 1, np.int64)
    # Every text gets a window at least: slots before its first gram are filled with the largest hash.
    slots = np.where(grams > 0, np.maximum(grams, window), 0)
    first = np.append(0, np.cumsum(slots))
    filled = slots - grams
    text = np.repeat(np.arange(len(lengths)), slots)
    offset = np.arange(first[-1]) - first[text] - filled[text]
    real = offset >= 0
    hashes = np.full(first[-1], np.iinfo(np.uint64).max, np.uint64)
    hashes[real] = rolling_hashes(points, bounds[text[real]] + offset[real], np.minimum(lengths, gram)[text[real]])
    _, place = window_minima(hashes, window)
    inside = np.arange(len(place)) + window <= first[1:][text[:len(place)]]
    place = place[inside]
    place = place[np.append(True, place[1:] != place[:-1])]
    place = place[real[place]]
    return hashes[place], offset[place], np.searchsorted(place, first)


def fingerprints(docs: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``hashes`` and ``positions``: the chosen hashes of each whole text in text order, and the code points at
    which their grams begin.

    A null or empty text has none. Rows are handled one by one; an empty table stays empty. Columns that already have one
    of the new names are replaced.
    """
    def make(columns: list[pa.Array]) -> list[pa.Array]:
        hashes, positions, begins = winnow(*code_points(*flat_text(columns[0])), gram, window)
        offsets = pa.array(begins.astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(positions.astype(np.int32)))]

    return add_columns(docs, [text], FIELDS, make, BLOCK_BYTES)


# ---- likeness, and fingerprints as text ----

def distinct_hashes(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order."""
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])) if len(hashes) else np.zeros(0, bool)
    return hashes[new], np.searchsorted(text[new], np.arange(len(begins)))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Jaccard index of each text of ``a`` with that of ``b`` in the same place, from distinct hashes; 1 for two empty
    fingerprints."""
    sizes = np.diff(a[1]) + np.diff(b[1])
    text = np.concatenate([np.repeat(np.arange(len(sizes)), np.diff(part[1])) for part in (a, b)])
    hashes = np.concatenate([a[0], b[0]])
    order = np.lexsort((hashes, text))
    twice = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    common = np.bincount(text[order][1:][twice], minlength=len(sizes)) if len(hashes) else np.zeros(len(sizes), np.int64)
    return np.where(sizes > 0, common / np.maximum(sizes - common, 1), 1.0)


def hex_lists(hashes: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Each text's hashes as words of 16 hexadecimal digits, joined by blanks."""
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    raw = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8)
    words = np.full((len(hashes), 17), ord(" "), np.uint8)
    words[:, 0:16:2], words[:, 1:16:2] = digits[raw >> 4], digits[raw & 15]
    # A text's last word is not followed by a blank.
    keep = np.ones((len(hashes), 17), bool)
    keep[begins[1:][np.diff(begins) > 0] - 1, 16] = False
    offsets = 17 * begins - np.append(0, np.cumsum(np.diff(begins) > 0))
    packed = words[keep]
    return pa.LargeStringArray.from_buffers(
        len(begins) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed)))


# ---- documents against their successors ----

RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compared(ids: pa.Array, texts: pa.Array, owned: np.ndarray, gram: int, window: int) -> pa.RecordBatch:
    """Results of the rows marked as owned, each against the row after it."""
    flat, bounds = flat_text(texts)
    points, begins = code_points(flat, bounds)
    lengths = np.diff(begins)
    rows = np.flatnonzero(owned)
    moved = np.minimum(lengths[rows] // 3, lengths[rows + 1])
    kept = lengths[rows] - lengths[rows] // 3
    # Kept part of a text and beginning of the next, in turn, as ranges of the code points.
    cuts = np.stack([begins[rows], begins[rows] + kept, begins[rows + 1], begins[rows + 1] + moved], axis=1).reshape(-1)
    pieces = np.arange(0, 4 * len(rows), 2)
    edited, piece_bounds = ragged_take(points, cuts, pieces)
    leads = np.append(np.flatnonzero(IS_LEAD[flat]), len(flat))
    edited_bytes, byte_bounds = ragged_take(flat, leads[cuts] if len(cuts) else cuts, pieces)
    edited_bounds, byte_bounds = piece_bounds[0::2], byte_bounds[0::2]

    own = winnow(points, begins, gram, window)
    new = winnow(edited, edited_bounds, gram, window)
    distinct, changed = distinct_hashes(own[0], own[2]), distinct_hashes(new[0], new[2])

    def pick(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ragged_take(distinct[0], distinct[1], which)

    mine = pick(rows)
    digests = [hashlib.sha256(edited_bytes[a:b]).hexdigest() for a, b in zip(byte_bounds[:-1], byte_bounds[1:])]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(rows)), pa.array(lengths[rows]), pa.array(digests, pa.string()),
         hex_lists(*ragged_take(own[0], own[2], rows)).cast(pa.string()), hex_lists(new[0], new[2]).cast(pa.string()),
         pa.array(likeness(mine, changed)), pa.array(likeness(mine, pick(rows + 1)))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_successors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM,
                       window: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint against that of an edited text and of its successor, in descending order of doc_id.

    The edited text has its last third (rounded down, in code points) replaced by as many first code points of the
    successor, or all it has; the last document's successor is the first, a single document's is itself. A null
    text is empty. Null ids come after all others; rows of one id are in order of a hash of their texts, so repeated
    rows follow each other. An empty table gives no rows. Other columns are not read.

    Boundaries of ranges are ids that stand in the table, so the first document of a range, which ends the range
    before it as the successor of its last, is known without looking at any text: texts are shuffled once. Rows of one
    id, and those without an id, are in one range each and read as a stream, whatever their number.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    ranges = ranges or min(MAX_RANGES, max(
        ids.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism))
    steps = [n / ranges for n in range(1, ranges)] or [0.5]
    found = ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, steps)), F.lit(100 * ranges)).alias("cuts"),
                    F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
    # Range n holds the ids from above firsts[n+1] up to firsts[n], descending; the one after them the null ids.
    firsts = np.array(sorted({*(found["cuts"] or []), *([] if found["last"] is None else [found["last"]])}, reverse=True),
                      np.int64)
    total = len(firsts) + (1 if found["nameless"] else 0)
    nameless = None
    if found["nameless"]:
        nameless = docs.where(F.col(doc_id).isNull()).agg(F.min(_text_key(text))).first()[0]
    ascending = firsts[::-1].copy()

    @F.arrow_udf(T.IntegerType())
    def range_of(values: pa.Array) -> pa.Array:
        numbers = values.fill_null(0).to_numpy(zero_copy_only=False)
        at = len(ascending) - 1 - np.searchsorted(ascending, numbers)
        return pa.array(np.where(values.is_null().to_numpy(zero_copy_only=False), total - 1, at).astype(np.int32))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("range", range_of("doc_id")).withColumn("order", _text_key("text"))
    leads = F.col("doc_id").isin([int(n) for n in firsts]) | (
        F.col("doc_id").isNull() & (F.lit(False) if nameless is None else F.col("order") == nameless))
    own = F.struct(F.col("range"), F.lit(True).alias("owned"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(max(total, 1))).alias("range"), F.lit(False).alias("owned"))
    placed = rows.withColumn("place", F.explode(F.when(leads, F.array(own, before)).otherwise(F.array(own)))).select(
        "place.range", "place.owned", "doc_id", "order", "text")
    placed = placed.repartitionById(max(total, 1), "range").sortWithinPartitions(
        "range", F.desc("owned"), F.desc_nulls_last("doc_id"), "order")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for batch in blocks(whole, 4, BLOCK_BYTES):
                if held is not None:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = batch.slice(batch.num_rows - 1)
                owned = batch.column(1).to_numpy(zero_copy_only=False).copy()
                owned[-1] = False
                if owned.any():
                    yield _compared(batch.column(2), batch.column(4), owned, gram, window)

    return bound_batches(placed).mapInArrow(compare, RESULT)


def _text_key(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
