"""How the sources of a language differ in their terms: exact counts by sorting pointers to term starts, then divergences.

A task takes blocks of whole texts as flat bytes and sorts pointers to the starts of their terms, as a multikey
quicksort whose characters are slices of eight bytes: all open runs are sorted by their next slice at once, and a run
goes on to the slice after it while its terms are equal so far and not at their end. A run of equal terms then gives
their occurrences and, since pointers of a run stay in text order, the documents they stand in, by language and
source. Spark adds up the counts of all tasks. Divergences are sums over blocks of terms, in whole numbers.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoindex.functions.sizing import small_side
from repoindex.llm.batches import blocks, bound_batches, byte_table, flat_text, staged, word_bounds

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
# (term, source) counts that one task compares; languages are cut into blocks of terms of about this size.
BLOCK_COUNTS = 200_000
# Sources that one task compares with all others of their language.
SOURCES_PER_TASK = 256
# Cells of the widest matrix a task holds while it compares sources.
BLOCK_CELLS = 1 << 21
SLICE = 8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IS_TERM = byte_table(b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)))

COUNTS = "lang string, source string, term string, n long, docs long"


# ---- counting in a task ----

def _slices(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight bytes from each start as one number that sorts like them; bytes past the end are zero, which no term has."""
    at = np.minimum(starts[:, None] + np.arange(SLICE), len(flat) - 1)
    taken = np.where(starts[:, None] + np.arange(SLICE) < ends[:, None], flat[at], 0).astype(np.uint8)
    return taken.view(">u8").reshape(-1).astype(np.uint64)


def sort_pointers(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their terms, equal ones in text order, and for each whether a new term begins there."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    key = _slices(flat, starts, ends)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    depth, places = 0, np.arange(len(order))
    while len(places):
        depth += SLICE
        # Whole runs with a term that goes on; their terms are equal up to here, and those at their end sort first.
        run = np.cumsum(new[places]) - 1
        goes_on = ends[order[places]] - starts[order[places]] > depth
        places = places[(np.bincount(run, goes_on) > 0)[run] & (np.bincount(run) > 1)[run]]
        pointers, run = order[places], np.cumsum(new[places])
        key = _slices(flat, starts[pointers] + depth, ends[pointers])
        inside = np.lexsort((key, run))
        order[places], key = pointers[inside], key[inside]
        new[places[1:]] |= key[1:] != key[:-1]
    return order, new


def block_counts(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a block with a group number, occurrences and documents: one entry per term and group that has it."""
    flat, bounds = flat_text(texts, end="\n")
    flat = LOWER[flat]
    starts, ends = word_bounds(flat, IS_TERM)
    order, new = sort_pointers(flat, starts, ends)
    if not len(order):
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3))
    term = np.cumsum(new) - 1
    text = np.searchsorted(bounds, starts[order], side="right") - 1
    first_in_text = new | np.append(True, text[1:] != text[:-1])
    cell, occurrences = np.unique(term * (int(group.max()) + 1) + group[text], return_counts=True)
    documents = np.bincount(np.searchsorted(cell, (term * (int(group.max()) + 1) + group[text])[first_in_text]),
                            minlength=len(cell))
    # The terms themselves, laid end to end.
    heads = order[new]
    lengths = ends[heads] - starts[heads]
    offsets = np.append(0, np.cumsum(lengths))
    packed = flat[np.repeat(starts[heads] - offsets[:-1], lengths) + np.arange(offsets[-1])]
    terms = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed))
    return terms.take(pa.array(cell // (int(group.max()) + 1))), cell % (int(group.max()) + 1), occurrences, documents


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term; nulls in the three columns are ''.

    Tasks send what they have counted in each block, and Spark adds it up before and after the shuffle.
    """
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c), empty).alias(c) for c in ("lang", "source", "text")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 2):
                pairs = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
                names = pairs.to_pandas().map(lambda pair: (pair["lang"], pair["source"]))
                group, known = names.factorize()
                terms, of_group, n, documents = block_counts(batch.column(2), group)
                lang = pa.array([pair[0] for pair in known], pa.string())
                source = pa.array([pair[1] for pair in known], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [lang.take(pa.array(of_group)), source.take(pa.array(of_group)), terms.cast(pa.string()),
                     pa.array(n, pa.int64()), pa.array(documents, pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])

    return bound_batches(rows).mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---- divergences ----

def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + terms).cast("decimal(20,0)")) + 1


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _pair_sums(table: pa.Table) -> pa.Table:
    """Divergence sums of ordered pairs of sources over the terms of one block, for some of the sources as the first.

    Rows without a term name every source of the language, with its base share, which holds for all terms of the block
    that it lacks. A source's shares are laid out over the block's terms and compared with some others at a time.
    """
    sources = table.filter(pa.compute.is_null(table["term"])).sort_by("source")
    names = sources["source"].combine_chunks()
    base, own = sources["p"].to_numpy(), np.flatnonzero(sources["own"].to_numpy())
    counted = table.filter(pa.compute.is_valid(table["term"]))
    of_source = pa.compute.index_in(counted["source"], names).to_numpy().astype(np.int64)
    terms = counted["term"].combine_chunks().dictionary_encode()
    of_term, share, width = terms.indices.to_numpy(), counted["p"].to_numpy(), len(terms.dictionary)
    order = np.argsort(of_source, kind="stable")
    begins = np.searchsorted(of_source[order], np.arange(len(base) + 1))

    def shares(first: int, last: int) -> np.ndarray:
        dense = np.repeat(base[first:last, None], width, axis=1)
        taken = order[begins[first]:begins[last]]
        dense[of_source[taken] - first, of_term[taken]] = share[taken]
        return dense

    step = max(1, BLOCK_CELLS // max(width, 1))
    found = [(np.zeros(0, np.int64),) * 3]
    for first in range(0, len(base), step):
        last = min(first + step, len(base))
        others = shares(first, last)
        for mine in own:
            gap = shares(mine, mine + 1) - others
            found.append((np.full(last - first, mine), np.arange(first, last), (gap * gap // others).sum(axis=1)))
    mine, other, value = (np.concatenate(part) for part in zip(*found, strict=True))
    lang = pa.repeat(table["lang"][0], len(mine))
    return pa.table({"lang": lang.cast(pa.string()), "source": names.take(pa.array(mine)).cast(pa.string()),
                     "item": names.take(pa.array(other)).cast(pa.string()), "value": pa.array(value, pa.int64())})


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value",
                       F.row_number().over(order).alias("rank"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS,
                      block_counts: int = BLOCK_COUNTS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and its terms.

    Null text, lang and source are ''. Terms are runs of letters A to Z and of characters from U+0080 on, of which only
    A to Z are lower-cased. A language keeps the terms of at least ``least_docs`` of its documents; repeated rows are
    documents of their own. ``pair`` rows compare a source with every other one of its language over all kept terms,
    also where neither has any (value 0); a language of one source has none. ``term`` rows are the terms a source
    has oftener than its language, at most ``top``. Ties go to the smaller item. An empty table gives no rows.

    Counts are exact sums over all documents, staged once. Languages are compared in blocks of terms, and where they
    have very many sources in slices of these too, so a task holds a bounded block, however large its language is.
    """
    empty = F.lit("")
    counts = staged(term_counts(docs), "divergence-counts")
    groups = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source")).distinct()
    kept = staged(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= least_docs).drop("docs"), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    counted = staged(counts.join(kept, ["lang", "term"]).drop("docs"), "divergence-kept")
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries"))
    groups = staged(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0), "divergence-groups")
    shape = groups.groupBy("lang").agg(
        F.greatest(F.ceil(F.sum("entries") / block_counts), F.lit(1)).cast("int").alias("blocks"),
        F.ceil(F.count(F.lit(1)) / SOURCES_PER_TASK).cast("int").alias("slices"))
    groups = small_side(staged(groups.join(shape, "lang"), "divergence-shape"))

    known = counted.join(groups, ["lang", "source"])
    shares = known.withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    slices, blocks_ = F.col("slices"), F.col("blocks")
    entries = shares.select(
        "lang", "source", "term", "p", F.pmod(F.xxhash64("term"), blocks_).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(False).alias("own"))
    base = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(1)
    names = groups.withColumn("p", base).select(
        "lang", "source", F.lit(None).cast("string").alias("term"), "p", "slices",
        F.explode(F.sequence(F.lit(0), blocks_ - 1)).alias("block"))
    names = names.select("lang", "source", "term", "p", "block", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"),
                         F.pmod(F.xxhash64("source"), slices).alias("_mine"))
    names = names.withColumn("own", F.col("_mine") == F.col("slice")).drop("_mine")
    pairs = entries.unionByName(names).groupBy("lang", "block", "slice").applyInArrow(
        _pair_sums, "lang string, source string, item string, value long")
    pairs = pairs.where("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    usual = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = shares.withColumn("q", usual).where("p > q").select(
        "lang", "source", F.col("term").alias("item"),
        div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(terms, "term").where(F.col("rank") <= top))
