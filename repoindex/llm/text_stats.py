"""Counts per text that quality rules and quality features share, for a block of whole texts at a time."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from repoindex.llm.batches import NOT_SPACE, byte_table, coded_words, flat_text, word_bounds

# Fixed values.
SYMBOLS = b"#*$%&|<>"
WINDOW = 3

IS_SYMBOL = byte_table(SYMBOLS)
# Bytes that begin a character.
IS_LEAD = (np.arange(256) & 0xC0) != 0x80


@dataclass
class Block:
    """The texts of a block, their words as codes, and where each text's words begin."""

    flat: np.ndarray
    bounds: np.ndarray
    words: pa.DictionaryArray
    codes: np.ndarray
    first_word: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> "Block":
        flat, bounds = flat_text(texts, end="\n")
        starts, ends = word_bounds(flat, NOT_SPACE)
        words = coded_words(flat, starts, ends, NOT_SPACE)
        return cls(flat, bounds, words, words.indices.to_numpy().astype(np.int64), np.searchsorted(starts, bounds))

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def count_bytes(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each text the table marks; the line end that was put after it is not counted."""
        return self.sums(table[self.flat], self.bounds) - table[ord("\n")]

    @staticmethod
    def sums(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(marks, dtype=np.int64))[bounds])

    def duplicate_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the same text."""
        ends = np.flatnonzero(self.flat == ord("\n"))
        offsets = np.append(0, ends - np.arange(len(ends))).astype(np.int64)
        packed = np.ascontiguousarray(self.flat[self.flat != ord("\n")])
        lines = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        text = np.searchsorted(self.bounds, ends, side="right") - 1
        spoken = self.sums(NOT_SPACE[self.flat], np.append(0, ends + 1)) > 0
        text, line = text[spoken], lines.indices.to_numpy().astype(np.int64)[spoken]
        distinct = np.unique(text * max(len(lines.dictionary), 1) + line) // max(len(lines.dictionary), 1)
        size = len(self.bounds) - 1
        return np.bincount(text, minlength=size) - np.bincount(distinct, minlength=size)

    def repeated_words(self) -> np.ndarray:
        """Words inside a three-word window that the text has twice or more."""
        count = len(self.codes)
        if count < WINDOW:
            return np.zeros(len(self.bounds) - 1, np.int64)
        text, codes, distinct = self.text_of_word, self.codes, max(len(self.words.dictionary), 1)
        if distinct < 1 << 21:
            key = (codes[:-2] * distinct + codes[1:-1]) * distinct + codes[2:]
        else:
            pair = np.unique(codes[:-2] * distinct + codes[1:-1], return_inverse=True)[1]
            key = pair * distinct + codes[2:]
        inside = np.flatnonzero(text[:-2] == text[2:])
        order = inside[np.argsort(key[inside], kind="stable")]
        # Windows come in order within a key, so equal ones of a text are neighbours.
        twice = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        repeated = np.zeros(count, bool)
        for place in (order[1:][twice], order[:-1][twice]):
            for step in range(WINDOW):
                repeated[place + step] = True
        return self.sums(repeated, self.first_word)
