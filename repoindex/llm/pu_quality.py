"""Quality classification from positives and unlabelled text: non-negative unbiased risk with an estimated class prior.

Texts become a short vector of shape features. Trusted documents are the positives, any web text is unlabelled; no
negative label is used. The class prior is estimated as the smallest ratio of unlabelled to positive mass over the sets
that a first classifier ranks highest (unlabelled mass there is at least prior times positive mass). The final
classifier minimises the non-negative PU risk: where the estimated risk on negatives would turn below zero, its
gradient is reversed, so that no text is scored by heart.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoindex.llm.batches import add_columns, byte_table
from repoindex.llm.text_stats import IS_LEAD, IS_SYMBOL, NOT_SPACE, Block

# The model is fitted on at most so many positive and so many unlabelled documents, chosen by a hash of their id.
POSITIVES = 20_000
UNLABELLED = 40_000
HIDDEN = 24
STEPS = 1500
BATCH = 512
RATE = 3e-3
DECAY = 1e-4
# Share of the positives that a set needs before its ratio counts for the prior.
LEAST_MASS = 0.3
SEED = 7

TABLES = {
    "letters": byte_table(bytes(range(65, 91)) + bytes(range(97, 123))) | (np.arange(256) >= 0xC0),
    "capitals": byte_table(bytes(range(65, 91))), "digits": byte_table(b"0123456789"), "symbols": IS_SYMBOL,
    "exclamations": byte_table(b"!?"), "stops": byte_table(b"."), "commas": byte_table(b",;:"),
    "lines": byte_table(b"\n"), "marks": byte_table(b"\"'()[]{}=+-_/\\@^~`"),
}
FEATURES = len(TABLES) + 11


def features(texts: pa.Array) -> np.ndarray:
    """One row per text, from whole texts; a text without words, null included, has only zeros but for its length."""
    block = Block.of(texts)
    words = block.n_words.astype(np.float64)
    some = np.maximum(words, 1)
    chars = block.count_bytes(IS_LEAD).astype(np.float64)
    inside = block.count_bytes(NOT_SPACE & IS_LEAD).astype(np.float64)
    text, codes = block.text_of_word, block.codes
    distinct_words = max(len(block.words.dictionary), 1)
    # How often each word of a text occurs in it.
    used, counts = np.unique(text * distinct_words + codes, return_counts=True)
    owner = used // distinct_words
    size = len(words)
    most = np.zeros(size)
    np.maximum.at(most, owner, counts)
    squares = np.bincount(owner, weights=counts.astype(np.float64) ** 2, minlength=size)
    lengths = np.array([len(w) for w in block.words.dictionary.to_pylist()], np.float64)[codes] if len(codes) else codes
    twins = np.bincount(text[1:][(codes[1:] == codes[:-1]) & (text[1:] == text[:-1])], minlength=size)
    spread = np.bincount(text, weights=np.square(lengths), minlength=size) / some
    columns = [block.count_bytes(table) / np.maximum(chars, 1) for table in TABLES.values()]
    columns += [
        np.log1p(words), inside / some, inside / np.maximum(chars, 1), np.bincount(owner, minlength=size) / some,
        most / some, squares / some ** 2, twins / some, block.duplicate_lines() / some * 10,
        block.repeated_words() / some, np.sqrt(np.maximum(spread - (inside / some) ** 2, 0)),
        np.minimum(words, 50) / 50,
    ]
    return np.stack(columns, axis=1)


@dataclass
class PuModel:
    """A network of one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        hidden = np.tanh(np.clip((rows - self.mean) / self.scale, -8, 8) @ w1 + b1)
        return sigmoid(hidden @ w2 + b2)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pu_slopes(g: np.ndarray, prior: float) -> np.ndarray:
    """Slopes of the non-negative risk by each raw output, for scores of as many positives as unlabelled, in this order.

    The loss of calling a text positive is 1 - g, of calling it negative g. The risk on negatives is estimated from the
    unlabelled less the positives among them; where that is below zero it is raised, and the rest of the risk waits.
    """
    half = len(g) // 2
    slope = g * (1 - g)
    if g[half:].mean() - prior * g[:half].mean() >= 0:
        return np.concatenate([-2 * prior * slope[:half], slope[half:]]) / half
    return np.concatenate([prior * slope[:half], -slope[half:]]) / half


def _train(x_p: np.ndarray, x_u: np.ndarray, prior: float | None) -> list[np.ndarray]:
    """Adam on the non-negative PU risk with the sigmoid loss, or without a prior on positives against unlabelled."""
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, 1 / np.sqrt(x_p.shape[1]), (x_p.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, STEPS + 1):
        x = np.concatenate([x_p[rng.integers(0, len(x_p), BATCH)], x_u[rng.integers(0, len(x_u), BATCH)]])
        hidden = np.tanh(x @ layers[0] + layers[1])
        g = sigmoid(hidden @ layers[2] + layers[3])
        if prior is None:
            out = np.concatenate([g[:BATCH] - 1, g[BATCH:]]) / BATCH
        else:
            out = pu_slopes(g, prior)
        back = out[:, None] * layers[2] * (1 - hidden ** 2)
        grads = [x.T @ back, back.sum(axis=0), hidden.T @ out, out.sum(keepdims=True)]
        for n, grad in enumerate(grads):
            grad = grad + DECAY * layers[n]
            first[n] = 0.9 * first[n] + 0.1 * grad
            second[n] = 0.999 * second[n] + 0.001 * grad ** 2
            layers[n] -= RATE * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
    return layers


def estimate_prior(scores_p: np.ndarray, scores_u: np.ndarray) -> float:
    """The smallest unlabelled mass per positive mass over the sets of highest scores."""
    edges = np.quantile(scores_p, np.linspace(0, 1 - LEAST_MASS, 50))
    masses = [((scores_u >= e).mean(), (scores_p >= e).mean()) for e in edges]
    return float(np.clip(min(u / p for u, p in masses), 0.05, 0.95))


def fit_pu(x_p: np.ndarray, x_u: np.ndarray) -> PuModel:
    """Fit on feature rows; without positives or unlabelled rows everything scores one half."""
    width = FEATURES
    if not len(x_p) or not len(x_u):
        return PuModel(np.zeros(width), np.ones(width),
                       [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)], 0.5)
    mean, scale = x_u.mean(axis=0), x_u.std(axis=0) + 1e-6
    z_p, z_u = (np.clip((x - mean) / scale, -8, 8) for x in (x_p, x_u))
    # Ranked by one half, measured on the other, so that the ranking cannot know its positives by heart.
    ranked = PuModel(np.zeros(width), np.ones(width), _train(z_p[::2], z_u[::2], None), 0.5)
    rest_p, rest_u = (z[1::2] if len(z) > 1 else z for z in (z_p, z_u))
    prior = estimate_prior(ranked.score(rest_p), ranked.score(rest_u))
    return PuModel(mean, scale, _train(z_p, z_u, prior), prior)


def sample_ids(ids: DataFrame, count: int) -> DataFrame:
    """The distinct ``doc_id`` of smallest hashes, at most ``count``; null ids are left out.

    Hashes are even over their range, so the smallest are found below a bound that about four times as many are under:
    tasks send those to be ranked, not ``count`` rows each.
    """
    hashed = ids.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    bound = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 4 * count // max(hashed.count(), 1))
    return hashed.where(F.col("h") <= F.lit(bound).cast("long")).orderBy("h", "doc_id").limit(count).select("doc_id")


def _sample_features(docs: DataFrame, ids: DataFrame, limit: int) -> np.ndarray:
    """Features of the documents with these ids, at most ``limit`` rows, in a fixed order."""
    chosen = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    packed = add_columns(chosen, ["text"], [T.StructField("x", T.BinaryType())], lambda columns: [
        pa.array([row.tobytes() for row in features(columns[0])], pa.binary())])
    rows = packed.select("x", F.xxhash64("doc_id", "x").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(limit).collect()
    return np.array([np.frombuffer(r["x"]) for r in rows]).reshape(len(rows), FEATURES)


def learn_quality(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES,
                  unlabelled: int = UNLABELLED) -> PuModel:
    """Fit on the given documents; labels ``quality`` = 1 name the trusted ones, other labels are not looked at.

    Unlabelled are any of the documents. Null ids, repeated labels and repeated rows add nothing.
    """
    docs = docs.select("doc_id", "text")
    trusted = sample_ids(labels.where("quality = 1").select("doc_id"), positives)
    x_p = _sample_features(docs, trusted, positives)
    x_u = _sample_features(docs, sample_ids(docs.select("doc_id"), unlabelled), unlabelled)
    return fit_pu(x_p, x_u)


def score_documents(docs: DataFrame, model: PuModel, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from one half on) to every document, empty and null texts included.

    Rows are handled one by one, so repeated rows give repeated results; columns of the new names are replaced.
    """
    fields = [T.StructField("score", T.DoubleType())]
    scored = add_columns(docs, [text], fields, lambda columns: [
        pa.array(np.round(model.score(features(columns[0])), 9))])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
