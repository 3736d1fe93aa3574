"""Language identification: string kernels over n-gram presence, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the number of byte n-grams (two to four bytes, hashed) that both have, over the geometric
mean of the numbers each has. Landmark texts span the feature space (Nyström), a ridge regression per language against
the rest is solved in it, and texts are scored by products of their presence matrix with the solution.

Scores tell languages apart, but add up to 1 whatever the text is. Whether a text is in a language at all is decided by the
share of its longest n-grams that other texts of that language have, against the same share of the texts it was learned from.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.llm.batches import add_columns, flat_text

SIZES = (2, 3, 4)
BUCKET_BITS = 18
# The model is fitted on at most so many texts and landmarks, as many of each language, and at most so many languages.
# Bytes of text that are scored at a time; their n-grams take some sixty times as much.
BLOCK_BYTES = 1 << 20
FIT_TEXTS = 2048
LANDMARKS = 256
LANGUAGES = 128
RIDGE = 1e-2
# Texts scored in one product.
ROWS = 64
# An n-gram is known in a language if this share of the texts fitted on, and so many at least, have it: a few strays among
# them make nothing known. A text is recognised if its share of known
# n-grams is at least this part of the median share of the texts fitted on, each held against the others.
KNOWN_SHARE, KNOWN_IN = 0.02, 2
LEAST_PART = 0.5
UNKNOWN = "und"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Fixed value: anything but a letter, as the regular expressions of Arrow and of Spark write it.
LETTER = r"\p{L}"

# ASCII that is no letter is one kind of gap.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = [b if chr(b).isalpha() else 0x20 for b in range(128)]


def presence(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The bucket at every position for each n-gram size, -1 where the n-gram would leave its text; the texts' bounds.

    After those of all sizes come the longest once more, -1 also where they have no letter.
    """
    flat, bounds = flat_text(pc.utf8_lower(texts.cast(pa.large_string())), end=" ")
    flat = FOLD[flat].astype(np.uint64)
    found = []
    for size in SIZES:
        if len(flat) < size:
            found.append(np.full(len(flat), -1, np.int64))
            continue
        code = np.full(len(flat) - size + 1, size, np.uint64)
        for step in range(size):
            code = code << np.uint64(8) | flat[step:len(flat) - size + 1 + step]
        bucket = np.full(len(flat), -1, np.int64)
        bucket[:len(code)] = (code * FACTOR >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        for step in range(1, size):
            cut = bounds[1:] - step
            bucket[cut[cut >= 0]] = -1
        found.append(bucket)
    gap = np.append(flat == 0x20, np.ones(SIZES[-1], bool))
    gaps = np.logical_and.reduce([gap[step:len(flat) + step] for step in range(SIZES[-1])])
    return [*found, np.where(gaps, -1, found[-1])], bounds


def bucket_sets(texts: pa.Array) -> list[np.ndarray]:
    found, bounds = presence(texts)
    sets = []
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        here = np.unique(np.concatenate([bucket[begin:end] for bucket in found[:-1]]))
        sets.append(here[here >= 0].astype(np.int32))
    return sets


def gram_counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every text the buckets of its longest n-grams, and at how many positions each is."""
    found, bounds = presence(texts)
    parts = (found[-1][begin:end] for begin, end in zip(bounds[:-1], bounds[1:], strict=True))
    return [tuple(part.astype(np.int32) for part in np.unique(here[here >= 0], return_counts=True)) for here in parts]


@dataclass
class LanguageModel:
    languages: list[str]
    place: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    # One row per language: whether a bucket is known in it; and the least share of known n-grams.
    known: np.ndarray | None = None
    least: np.ndarray | None = None

    @classmethod
    def fit(cls, sets: list[np.ndarray], languages: list[str]) -> "LanguageModel":
        """Solve the ridge regression on sets of buckets in a fixed order; the first of each language are landmarks."""
        names = sorted(set(languages))
        rank: dict[str, int] = {}
        landmark = np.zeros(len(sets), bool)
        for at, name in enumerate(languages):
            rank[name] = rank.get(name, 0) + 1
            landmark[at] = rank[name] <= LANDMARKS // len(names)
        chosen = [found for found, mark in zip(sets, landmark, strict=True) if mark]
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.int32), *chosen]))
        place = np.full(1 << BUCKET_BITS, -1, np.int32)
        place[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
        if not len(vocabulary):
            return cls(names, place, np.zeros((0, len(names))), np.zeros(len(names)))
        marks = np.zeros((len(vocabulary), len(chosen)), np.float32)
        for at, found in enumerate(chosen):
            marks[place[found], at] = 1 / np.sqrt(len(found))
        values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
        strong = values > 1e-6 * values.max()
        to_space = vectors[:, strong] / np.sqrt(values[strong])
        kernel = np.zeros((len(sets), len(chosen)))
        for at, found in enumerate(sets):
            known = place[found]
            known = known[known >= 0]
            kernel[at] = marks[known].sum(axis=0) / np.sqrt(max(len(known), 1))
        space = kernel @ to_space
        target = (np.array(languages)[:, None] == np.array(names)[None, :]).astype(np.float64)
        mean, offset = space.mean(axis=0), target.mean(axis=0)
        centred = space - mean
        solution = np.linalg.solve(centred.T @ centred + RIDGE * len(sets) * np.eye(space.shape[1]),
                                   centred.T @ (target - offset))
        # Landmarks and solution folded into one weight per bucket and language.
        weights = marks @ (to_space @ solution)
        return cls(names, place, weights.astype(np.float32), (offset - mean @ solution).astype(np.float32))

    def learn_known(self, grams: list[tuple[np.ndarray, np.ndarray]], languages: list[str]) -> None:
        """Mark the n-grams that each language has, and take the least share from its texts, each held against the others."""
        self.known = np.zeros((len(self.languages), 1 << BUCKET_BITS), bool)
        self.least = np.zeros(len(self.languages))
        for at, name in enumerate(self.languages):
            mine = [pair for pair, lang in zip(grams, languages, strict=True) if lang == name and len(pair[0])]
            texts_with = np.bincount(np.concatenate([np.zeros(0, np.int32), *(b for b, _ in mine)]),
                                     minlength=1 << BUCKET_BITS)
            needed = max(KNOWN_IN, KNOWN_SHARE * len(mine))
            self.known[at] = texts_with >= needed
            shares = [n[texts_with[b] - 1 >= needed].sum() / n.sum() for b, n in mine]
            self.least[at] = LEAST_PART * np.median(shares) if shares else 0

    def recognise(self, found: list[np.ndarray], bounds: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether each text has the n-grams of the language it was given.

        Chance moves the share of ``n`` n-grams, of which neighbours overlap, by up to 1 / sqrt(n): that much is allowed.
        """
        bucket, row = found[-1], np.repeat(np.arange(len(best)), np.diff(bounds))
        ok = bucket >= 0
        bucket, row = bucket[ok], row[ok]
        total = np.maximum(np.bincount(row, minlength=len(best)), 1)
        known = np.bincount(row[self.known[best[row], bucket]], minlength=len(best))
        return known / total + 1 / np.sqrt(total) >= self.least[best]

    def score(self, texts: pa.Array) -> np.ndarray:
        """One row per text, one column per language: products of presence rows with the weights."""
        return self.score_found(*presence(texts))

    def score_found(self, found: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
        known = [np.where(bucket >= 0, self.place[bucket], -1) for bucket in found[:-1]]
        size = len(bounds) - 1
        out = np.zeros((size, len(self.languages)), np.float32)
        width = len(self.weights)
        for first in range(0, size, ROWS):
            last = min(first + ROWS, size)
            begin, end = bounds[first], bounds[last]
            row = np.repeat(np.arange(last - first), np.diff(bounds[first:last + 1]))
            marks = np.zeros(width * (last - first), np.float32)
            for place in known:
                here = place[begin:end]
                ok = here >= 0
                marks[row[ok] * width + here[ok]] = 1
            marks = marks.reshape(last - first, width)
            norm = np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
            out[first:last] = marks @ self.weights / norm + self.offset
        return out


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on documents with a language and a letter: of the ``LANGUAGES`` most frequent languages as many distinct texts
    each, those with the smallest hashes, ``FIT_TEXTS`` in all. Only their n-gram buckets come to the driver."""
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).withColumn("h", F.xxhash64("text"))
    keys = known.select("lang", "h").distinct()
    counts = {row["lang"]: row["count"] for row in keys.groupBy("lang").count().orderBy(
        F.desc("count"), "lang").limit(LANGUAGES).collect()}
    each = FIT_TEXTS // max(len(counts), 1)
    if not counts:
        return LanguageModel.fit([], [])
    # Hashes are even over their range, so the smallest are found below a bound that about four times as many are under:
    # a frequent language is not ranked as a whole.
    bounds = F.create_map(*[x for lang, count in counts.items() for x in (
        F.lit(lang), F.lit(min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 4 * each // count)).cast("long"))])
    first = keys.where(F.col("h") <= bounds[F.col("lang")]).withColumn(
        "rank", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= each)
    chosen = known.join(F.broadcast(first), ["lang", "h"])
    fields = [T.StructField(name, T.BinaryType()) for name in ("buckets", "grams", "times")]

    def make(columns):
        grams = gram_counts(columns[0])
        return [pa.array([part.tobytes() for part in parts], pa.binary()) for parts in (
            bucket_sets(columns[0]), [b for b, _ in grams], [n for _, n in grams])]

    sampled = add_columns(chosen.select("text", "lang", "h", "rank"), ["text"], fields, make).drop("text")
    rows = sampled.dropDuplicates(["lang", "h"]).orderBy("lang", "rank").collect()
    languages = [r["lang"] for r in rows]
    model = LanguageModel.fit([np.frombuffer(r["buckets"], np.int32) for r in rows], languages)
    model.learn_known([(np.frombuffer(r["grams"], np.int32), np.frombuffer(r["times"], np.int32)) for r in rows], languages)
    return model


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``recognised`` to every document.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned; these are
    not recognised, and neither is a text that has too few of the n-grams of its language (``LEAST_PART``). A text
    whose n-grams are all unknown gets the language of the largest offset. Ties go to the first name in order. Rows are
    handled one by one; columns named like the new ones are replaced.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("recognised", T.BooleanType())]
    names = pa.array([*model.languages, UNKNOWN], pa.string())

    def make(columns):
        texts = pc.fill_null(columns[0], "")
        spoken = pc.match_substring_regex(texts, LETTER).to_numpy(zero_copy_only=False).astype(bool)
        if not model.languages:
            return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts))),
                    pa.array(np.zeros(len(texts), bool))]
        found = presence(texts)
        scores = model.score_found(*found)
        recognised = spoken & model.recognise(*found, scores.argmax(axis=1))
        best = np.where(spoken, scores.argmax(axis=1), len(model.languages))
        top = np.where(spoken, np.clip(scores.max(axis=1), 0, 1), 0).astype(np.float64)
        return [names.take(pa.array(best)), pa.array(np.round(top, 6)), pa.array(recognised)]

    return add_columns(docs, [text], fields, make, BLOCK_BYTES)


