"""Byte-level BPE: batched merge rounds over the distinct words of a block, and the way back.

The words of a block are found by classifying its bytes, its distinct words are merged together in one flat array
of symbols, and every text is then the ids of its words laid end to end. A round looks up all neighbouring pairs by
binary search in the sorted pair keys, takes the lowest rank of each word and merges its occurrences from the left.
The ids are those of the ``tokenizers`` library for a byte-level model without normaliser, truncation and padding.
"""

import json
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from repoindex.llm.batches import add_columns, flat_text, ragged_take

OTHER, LETTER, NUMBER, SPACE = range(4)
# Bytes of text encoded or of ids decoded at a time: the arrays of a block take some fifty times as much, and a worker keeps most of it.
BLOCK_BYTES = 512 << 10
# Words a task remembers; when full, it begins anew.
KNOWN_WORDS = 150_000
NO_RANK = np.iinfo(np.int64).max

# The code points of white space, and what an apostrophe splits off.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER_ENDINGS = b"stmd"
TWO_LETTER_ENDINGS = [b"re", b"ve", b"ll"]


def code_point_classes() -> np.ndarray:
    classes = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x110000):
        group = unicodedata.category(chr(point))[0]
        if group == "L":
            classes[point] = LETTER
        elif group == "N":
            classes[point] = NUMBER
    classes[SPACES] = SPACE
    return classes


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the model's file: itself if printable, else the next free one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in set(printable)):
        letters[chr(256 + n)] = b
    return letters


class ByteBpe:
    """Merge tables and classes of a byte-level model, small enough to go to every task: a few megabytes."""

    def __init__(self, vocabulary: dict[str, int], merges: list, specials: dict[str, int]):
        alphabet = byte_alphabet()
        self.size = max([*vocabulary.values(), *specials.values()]) + 1
        pieces = [b""] * self.size
        for token, number in vocabulary.items():
            if token not in specials:
                pieces[number] = bytes(alphabet[c] for c in token)
        for token, number in specials.items():
            pieces[number] = token.encode()
        self.pieces = pa.array(pieces, pa.large_binary())
        self.specials = {token.encode(): number for token, number in specials.items()}
        self.byte_ids = np.array([vocabulary[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys))[order]
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)[order]
        self.classes = code_point_classes()
        self.known, self.known_ids, self.known_bounds = {}, np.zeros(0, np.int64), np.zeros(1, np.int64)

    @classmethod
    def from_file(cls, path: str) -> "ByteBpe":
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        specials = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        return cls(model["model"]["vocab"], model["model"]["merges"], specials)

    # ---- words ----

    def byte_classes(self, flat: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        classes = self.classes[flat]
        leads = np.flatnonzero(flat >= 0xC0)
        if len(leads):
            padded = np.concatenate([flat, np.zeros(3, np.uint8)]).astype(np.uint32)
            first, tail = padded[leads], [padded[leads + n] & 0x3F for n in (1, 2, 3)]
            two, three = (first & 0x1F) << 6 | tail[0], (first & 0x0F) << 12 | tail[0] << 6 | tail[1]
            four = (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
            found = self.classes[np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))]
            width = 2 + (first >= 0xE0) + (first >= 0xF0)
            for n in range(4):
                classes[leads[width > n] + n] = found[width > n]
        return classes

    def special_spans(self, flat: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Where a special token stands literally within one text."""
        spans, buffer = [], flat.tobytes()
        for token in self.specials:
            at = buffer.find(token)
            while at >= 0:
                end = at + len(token)
                if np.searchsorted(bounds, at, "right") == np.searchsorted(bounds, end - 1, "right"):
                    spans.append((at, end))
                    at = buffer.find(token, end)
                else:
                    at = buffer.find(token, at + 1)
        return spans

    def word_starts(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the words of all texts begin; a word ends where the next begins."""
        size = len(flat)
        forced = np.zeros(size + 1, dtype=bool)
        forced[bounds] = True
        for at, end in self.special_spans(flat, bounds):
            forced[[at, end]] = True
        classes = self.byte_classes(flat)
        start = forced.copy()
        start[1:size] |= classes[1:] != classes[:-1]
        runs = np.flatnonzero(start[:size])
        ends = np.append(runs[1:], size)
        kinds = classes[runs]
        # The last white space before something else: a blank goes with what follows, any other stands alone.
        followed = np.flatnonzero((kinds[:-1] == SPACE) & ~forced[runs[1:]])
        after = ends[followed]
        last = after - 1
        for _ in range(3):
            last = np.where((flat[last] & 0xC0) == 0x80, last - 1, last)
        start[last] = True
        start[after[flat[after - 1] == 0x20]] = False
        # An apostrophe that begins a word splits off with its ending.
        marks = np.flatnonzero((kinds[:-1] == OTHER) & (flat[runs[:-1]] == 0x27) & (ends[:-1] - runs[:-1] == 1)
                               & (kinds[1:] == LETTER) & ~forced[runs[1:]] & start[runs[:-1]])
        for run in marks:
            at, room = int(runs[run]) + 1, int(ends[run + 1] - runs[run + 1])
            ending = flat[at:at + 2].tobytes()
            taken = 1 if ending[:1] in {bytes([b]) for b in ONE_LETTER_ENDINGS} else 2 if (
                room >= 2 and ending in TWO_LETTER_ENDINGS) else 0
            if taken:
                start[at] = False
                start[at + taken] = True
        # Inside a special token nothing begins.
        for at, end in self.special_spans(flat, bounds):
            start[at + 1:end] = False
        return np.flatnonzero(start[:size])

    # ---- merging ----

    def pair_ranks(self, word: np.ndarray, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging the symbols at ``at`` with their right neighbours, by binary search."""
        if not len(symbols):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        right = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] * self.size + symbols[right]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = (right > at) & (word[at] == word[right]) & (self.keys[place] == key)
        return np.where(fits, self.ranks[place], NO_RANK), self.merged[place]

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge_words``; words of earlier blocks are remembered, ``KNOWN_WORDS`` at most."""
        spelled = words.to_pylist()
        if len(self.known) + len(spelled) > KNOWN_WORDS:
            self.known, self.known_ids, self.known_bounds = {}, np.zeros(0, np.int64), np.zeros(1, np.int64)
        places = np.fromiter(map(self.known.get, spelled, repeat(-1)), np.int64, len(spelled))
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            ids, bounds = self.merge_words(words.take(pa.array(fresh)))
            places[fresh] = len(self.known) + np.arange(len(fresh))
            self.known.update(zip(map(spelled.__getitem__, fresh.tolist()), places[fresh].tolist(), strict=True))
            self.known_bounds = np.concatenate([self.known_bounds, self.known_bounds[-1] + bounds[1:]])
            self.known_ids = np.concatenate([self.known_ids, ids])
        return ragged_take(self.known_ids, self.known_bounds, places)

    def merge_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, laid end to end, and where each word's begin."""
        count = len(words)
        special = pc.index_in(words, pa.array(list(self.specials), words.type))
        numbers = np.array([*self.specials.values(), -1], np.int64)[special.fill_null(-1).to_numpy()]
        flat, offsets = _flat_binary(words)
        word = np.repeat(np.arange(count), np.diff(offsets))
        plain = numbers[word] < 0
        word, symbols = word[plain], self.byte_ids[flat[plain]]
        done_words, done_symbols = [np.flatnonzero(numbers >= 0)], [numbers[numbers >= 0]]
        rank, into = self.pair_ranks(word, symbols, np.arange(len(symbols)))
        while len(symbols):
            firsts = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
            lowest = np.repeat(np.minimum.reduceat(rank, firsts), np.diff(np.append(firsts, len(word))))
            live = lowest != NO_RANK
            if not live.all():
                done_words.append(word[~live])
                done_symbols.append(symbols[~live])
                word, symbols, rank, into, lowest = (a[live] for a in (word, symbols, rank, into, lowest))
            merge = np.flatnonzero(rank == lowest)
            if not len(merge):
                break
            # Overlapping occurrences, as in "aaa": every other one, from the left.
            begins = np.append(True, np.diff(merge) != 1)
            place = np.arange(len(merge))
            merge = merge[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            symbols[merge] = into[merge]
            keep = np.ones(len(symbols), dtype=bool)
            keep[merge + 1] = False
            word, symbols, rank, into = (a[keep] for a in (word, symbols, rank, into))
            # Only the pairs on either side of a merged symbol have changed.
            merge -= np.arange(len(merge))
            beside = np.zeros(len(symbols), dtype=bool)
            beside[merge] = beside[np.maximum(merge - 1, 0)] = True
            changed = np.flatnonzero(beside)
            rank[changed], into[changed] = self.pair_ranks(word, symbols, changed)
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        bounds = np.zeros(count + 1, dtype=np.int64)
        np.cumsum(np.bincount(word, minlength=count), out=bounds[1:])
        return symbols[np.argsort(word, kind="stable")], bounds

    # ---- texts ----

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, laid end to end, and where each text's begin."""
        flat, bounds = flat_text(texts)
        if not len(flat):
            return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        starts = self.word_starts(flat, bounds)
        offsets = np.append(starts, len(flat)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
        coded = words.dictionary_encode()
        ids, word_bounds = self.word_ids(coded.dictionary)
        tokens, token_bounds = ragged_take(ids, word_bounds, coded.indices.to_numpy().astype(np.int64))
        return tokens, token_bounds[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of ragged ids; bytes that are no UTF-8 become U+FFFD."""
        flat, offsets = _flat_binary(pc.take(self.pieces, pa.array(ids, pa.int64())))
        whole = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets[bounds].astype(np.int64)),
                                                 pa.py_buffer(np.ascontiguousarray(flat))])
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in whole.to_pylist()], pa.string())


def _flat_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else (
        np.zeros(1, np.int64))
    flat = np.frombuffer(data, np.uint8)[int(bounds[0]):int(bounds[-1])] if data is not None else np.zeros(0, np.uint8)
    return flat, bounds - bounds[0]


def _packed(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    packed = ids.astype("<u4").view(np.uint8)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * 4), pa.py_buffer(packed)])


def encode_texts(df: DataFrame, model: ByteBpe, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``token_ids``, the ids as little-endian unsigned 32-bit integers.

    A null or empty text has no tokens and empty ids. Every row is encoded by itself, so repeated rows give repeated
    results and an empty table an empty one. Columns named like the new ones are replaced, all others stay.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]

    def make(columns):
        ids, bounds = model.encode(columns[0])
        return [pa.array(np.diff(bounds)), _packed(ids, bounds)]

    return add_columns(df, [text], fields, make, BLOCK_BYTES)


def decode_tokens(df: DataFrame, model: ByteBpe, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Add the text of packed ids. Null ids give the empty text; special tokens are written out."""

    def make(columns):
        flat, bounds = _flat_binary(pc.fill_null(columns[0].cast(pa.large_binary()), b""))
        return [model.decode(np.ascontiguousarray(flat).view("<u4").astype(np.int64), bounds // 4)]

    return add_columns(df, [ids], [T.StructField(into, T.StringType())], make, BLOCK_BYTES)


def encode_and_decode(df: DataFrame, model: ByteBpe, text: str = "text", into: str = "decoded") -> DataFrame:
    """``encode_texts`` and ``decode_tokens`` in one: the ids of a block are packed, read again and decoded at once."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()),
              T.StructField(into, T.StringType())]

    def make(columns):
        ids, bounds = model.encode(columns[0])
        packed = _packed(ids, bounds)
        flat, places = _flat_binary(packed)
        return [pa.array(np.diff(bounds)), packed,
                model.decode(np.ascontiguousarray(flat).view("<u4").astype(np.int64), places // 4)]

    return add_columns(df, [text], fields, make, BLOCK_BYTES)
