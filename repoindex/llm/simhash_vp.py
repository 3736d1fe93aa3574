"""SimHash fingerprints and their near pairs by vantage-point trees over Hamming distance.

Two fingerprints that differ in at most ``MAX_BITS`` bits agree in all but that many of the bands the 64 bits are cut
into, so for one of the band sets the distance over its bits is at most a small radius (zero from four bands on). Each
band set has a vantage-point tree over this distance: a node sends a fingerprint left or right of the median distance
to its vantage point, a fingerprint within the radius of the border also visits the other side (triangle bound). The
leaves are the shards; each is searched by a tree of its own, and only pairs that are verified on all 64 bits link.

One tree over all bits (``bands=1``, radius 3) is the same search, but random fingerprints lie at 32 +- 4 bits of any
vantage point: two thirds of them are within three bits of a median and visit both sides of every node. More bands
keep the search exact and the shards disjoint.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.functions.sizing import small_side
from repoindex.llm.batches import NOT_SPACE, add_columns, flat_text, staged, word_bounds
from repoindex.llm.components import connected

MAX_BITS = 3
BANDS = 5
SHINGLE = 3
SEED = 42
# Fingerprints from which the shard trees are built: they decide how even shards are, never what is found.
SAMPLE = 16_384
SAMPLE_PER_LEAF = 16
# Below this a shard is compared outright.
OUTRIGHT = 256
# Comparing n values outright costs n * n, so a division whose parts add up to over 1.4 times n does not pay.
WASTED = 1.3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


# ---- fingerprints ----

def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Bit by bit the majority over the hashes of a text's shingles, repeats included; zero for a text without words."""
    flat, bounds = flat_text(texts, end="\n")
    flat = LOWER[flat]
    starts, ends = word_bounds(flat, NOT_SPACE)
    first_word = np.searchsorted(starts, bounds)
    # Each word followed by one blank: a shingle is then one slice.
    keep = NOT_SPACE[flat]
    keep[ends] = True
    flat = np.where(NOT_SPACE[flat], flat, np.uint8(0x20))[keep]
    stops = np.cumsum(ends - starts + 1) - 1
    begins = stops - (ends - starts)
    buffer, digest = flat.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    begins, stops, first_word = begins.tolist(), stops.tolist(), first_word.tolist()
    for row in range(len(out)):
        first, last = first_word[row], first_word[row + 1]
        if first == last:
            continue
        size = min(shingle, last - first)
        hashes = np.array([digest(buffer[b:e], SEED) for b, e in zip(
            begins[first:last - size + 1], stops[first + size - 1:last], strict=True)], np.uint64)
        out[row] = majority(hashes)
    return out


def majority(hashes: np.ndarray) -> np.uint64:
    """A bit is set if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def add_fingerprint(docs: DataFrame, text: str = "text", into: str = "simhash", shingle: int = SHINGLE) -> DataFrame:
    """Add the SimHash of each text as a long (the same 64 bits, signed); null and wordless texts have zero."""
    return add_columns(docs, [text], [T.StructField(into, T.LongType())],
                       lambda columns: [pa.array(fingerprints(columns[0], shingle).view(np.int64))])


# ---- trees ----

def band_masks(bands: int, bits: int = MAX_BITS) -> tuple[np.ndarray, int]:
    """Band sets, as masks, and the radius within which a near pair lies over at least one of them."""
    edges = [round(64 * b / bands) for b in range(bands + 1)]
    masks = [((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in range(bands)]
    if bands <= bits:
        return np.array(masks, np.uint64), bits // bands
    return np.array([sum(chosen) for chosen in combinations(masks, bands - bits)], np.uint64), 0


def distance(values: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((values ^ vantage) & mask)


class VantageTree:
    """A binary tree in arrays; node ``n`` has children ``left[n]`` and ``right[n]``, leaves have none."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, per_leaf: int):
        self.mask = mask
        self.vantage, self.border, self.left, self.right = [], [], [], []
        self.leaves = 0
        self._grow(sample, per_leaf)

    def _grow(self, values: np.ndarray, per_leaf: int) -> int:
        node = len(self.vantage)
        for part in (self.vantage, self.border, self.left, self.right):
            part.append(-1)
        vantage, border = split_point(values, self.mask) if len(values) > per_leaf else (None, None)
        if vantage is None:
            self.border[node], self.vantage[node] = self.leaves, np.uint64(0)
            self.leaves += 1
            return node
        self.vantage[node], self.border[node] = vantage, border
        near = distance(values, vantage, self.mask) <= border
        self.left[node] = self._grow(values[near], per_leaf)
        self.right[node] = self._grow(values[~near], per_leaf)
        return node

    def shards(self, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, places of values, whether at home there) for every leaf that a ball of the radius reaches."""
        todo = [(0, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, places, home = todo.pop()
            if not len(places):
                continue
            if self.left[node] < 0:
                yield self.border[node], places, home
                continue
            apart = distance(values[places], self.vantage[node], self.mask).astype(np.int64)
            inner = apart <= self.border[node]
            reach_in, reach_out = apart - radius <= self.border[node], apart + radius > self.border[node]
            todo.append((self.left[node], places[reach_in], (home & inner)[reach_in]))
            todo.append((self.right[node], places[reach_out], (home & ~inner)[reach_out]))


def split_point(values: np.ndarray, mask: np.uint64) -> tuple:
    """A vantage point and a border that divide the values as evenly as the first few candidates allow, or None."""
    best = (None, None, len(values))
    for place in range(0, len(values), max(1, len(values) // 4)):
        apart = distance(values, values[place], mask)
        border = int(np.sort(apart)[(len(apart) - 1) // 2])
        for edge in (border, border - 1):
            inside = int((apart <= edge).sum())
            if 0 < inside < len(values) and abs(len(values) - 2 * inside) < best[2]:
                best = (values[place], edge, abs(len(values) - 2 * inside))
    return best[0], best[1]


def near_pairs(home: np.ndarray, guests: np.ndarray, mask: np.uint64, radius: int, bits: int, join) -> None:
    """Call ``join(a, b)`` with arrays of places of near values: home with home, and home with guests."""
    values = np.concatenate([home, guests])
    todo = [(np.arange(len(values)), np.arange(len(values)) < len(home))]
    while todo:
        places, own = todo.pop()
        here = values[places]
        vantage, border = split_point(here, mask) if len(here) > OUTRIGHT else (None, None)
        if vantage is None:
            _compare(values, places, own, bits, join)
            continue
        apart = distance(here, vantage, mask).astype(np.int64)
        inner = apart <= border
        reach_in, reach_out = apart - radius <= border, apart + radius > border
        if reach_in.sum() + reach_out.sum() > WASTED * len(here):
            _compare(values, places, own, bits, join)
            continue
        todo.append((places[reach_in], (own & inner)[reach_in]))
        todo.append((places[reach_out], (own & ~inner)[reach_out]))


def _compare(values: np.ndarray, places: np.ndarray, own: np.ndarray, bits: int, join) -> None:
    """Compare every value at home with every other one, some rows at a time."""
    rows = places[own]
    if not len(rows) or len(places) < 2:
        return
    step = max(1, (1 << 20) // len(places))
    for at in range(0, len(rows), step):
        part = rows[at:at + step]
        close = np.bitwise_count(values[part][:, None] ^ values[places][None, :]) <= bits
        a, b = np.nonzero(close)
        a, b = part[a], places[b]
        differ = a != b
        if differ.any():
            join(a[differ], b[differ])


class Forest:
    """Union-find over the values of one shard: a chain of links per group instead of all its pairs."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            if (x == y).all():
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def near_links(values: DataFrame, column: str = "simhash", bands: int = BANDS, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints such that the linked groups are those of all near pairs.

    A shard gives each of its fingerprints that has a near one a link to the first of its group there, so links grow
    with the fingerprints, not with the pairs.
    """
    masks, radius = band_masks(bands, bits)
    sample = values.select(column).orderBy(F.xxhash64(column)).limit(SAMPLE)
    known = np.sort(np.array([row[0] for row in sample.toLocalIterator()], np.int64)).view(np.uint64)
    spread = np.random.default_rng(SEED).permutation(known)
    trees = [VantageTree(spread, mask, SAMPLE_PER_LEAF) for mask in masks]

    def deal(batches):
        for batch in batches:
            here = batch.column(0).to_numpy().view(np.uint64)
            for number, tree in enumerate(trees):
                dealt = list(tree.shards(here, radius))
                if dealt:
                    leaves, places, home = zip(*dealt, strict=True)
                    at = np.concatenate(places)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), number, np.int32)),
                         pa.array(np.repeat(np.array(leaves, np.int32), [len(p) for p in places])),
                         pa.array(here[at].view(np.int64)), pa.array(np.concatenate(home))],
                        ["tree", "leaf", "value", "home"])

    def search(batches):
        for number, here, home in _groups(batches):
            forest = Forest(len(here))
            order = np.argsort(~home, kind="stable")
            here = here[order]
            own = int(home.sum())
            near_pairs(here[:own], here[own:], masks[number], radius, bits, forest.join)
            linked = np.flatnonzero(forest.root != np.arange(len(here)))
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(here[linked].view(np.int64)), pa.array(here[forest.root[linked]].view(np.int64))],
                    ["a", "b"])

    dealt = values.select(column).mapInArrow(deal, "tree int, leaf int, value long, home boolean")
    return dealt.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf").mapInArrow(search, "a long, b long")


def _groups(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The shards of a sorted partition one after the other; a shard may span batches."""
    key, held = None, []
    for batch in batches:
        tree, leaf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        value, home = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (leaf[1:] != leaf[:-1])) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(tree)], strict=True):
            if begin == end:
                continue
            if key is not None and key != (tree[begin], leaf[begin]):
                yield key[0], *(np.concatenate(part) for part in zip(*held, strict=True))
                held = []
            key = (tree[begin], leaf[begin])
            held.append((value[begin:end], home[begin:end]))
    if held:
        yield key[0], *(np.concatenate(part) for part in zip(*held, strict=True))


# ---- groups of documents ----

def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS,
                    bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row (doc_id, simhash, root, component_id) per document: component_id is the smallest doc_id reachable by links
    between fingerprints that differ in at most ``bits`` bits, root the smallest fingerprint of the group.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows stay repeated. Documents with
    a null doc_id take part in the links but never name a group; a group of nothing else has component_id null.
    An empty table gives an empty table. Equal fingerprints are one value before any search, so a large group of copies
    costs one value; fingerprints, values and links are staged in the shared folder.
    """
    marked = staged(add_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                                    shingle=shingle).drop("text"), "simhash")
    values = staged(marked.groupBy("simhash").agg(F.min("doc_id").alias("first_id")), "simhash-values")
    groups = connected(near_links(values, bands=bands, bits=bits))
    named = values.join(groups, values["simhash"] == groups["node"], "left").select(
        "simhash", "first_id", F.coalesce("root", "simhash").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    parts = named.join(smallest, "root").select("simhash", "root", "component_id")
    return marked.join(parts, "simhash").select("doc_id", "simhash", "root", "component_id")


def hex_of(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates, with the columns it came with: the smallest doc_id's.

    Of rows that share this doc_id one stays, chosen by a hash of its text; where a group has no doc_id but null, one
    of its rows stays. Texts of ids that are all different are not shuffled if the ids to drop are few.
    """
    groups = staged(near_duplicates(docs, **options), "simhash-groups")
    repeated = groups.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id")
    odd = staged(repeated.union(groups.where("doc_id IS NULL").select("doc_id").limit(1)), "simhash-repeated")
    dropped = groups.where("doc_id <> component_id").select("doc_id").union(odd).where("doc_id IS NOT NULL").distinct()
    plain = docs.where("doc_id IS NOT NULL").join(small_side(dropped), "doc_id", "left_anti").select(*docs.columns)
    if odd.isEmpty():
        return plain
    of_value = groups.groupBy(F.col("simhash").alias("_value")).agg(F.first("root").alias("_root"), F.first("component_id").alias("_least"))
    rest = docs.join(small_side(odd), docs["doc_id"].eqNullSafe(odd["doc_id"]), "left_semi")
    marked = add_fingerprint(rest, into="_simhash")
    marked = marked.join(of_value, marked["_simhash"] == of_value["_value"]).where(
        F.col("_least").eqNullSafe(F.col("doc_id")))
    chosen = marked.groupBy("_root").agg(F.min_by(
        F.struct(*[marked[c] for c in docs.columns]), F.xxhash64("text")).alias("_row"))
    return plain.unionByName(chosen.select("_row.*"))
