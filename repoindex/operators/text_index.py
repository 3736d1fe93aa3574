"""Text search over postings on disk that reads and moves little: pruned folders, counts per word, bounded top k.

The index lies in folders by a hash of the lexeme, so a question reads the folders of its words whatever their number,
with a small table beside it: in how many chunks of a namespace and kind a lexeme stands, and how often at most in one.
From these a search decides before it reads which words must find the chunks and which only add to their rank:

- a group of required words finds its chunks by the rarest of them; the others are looked up in those only;
- of a question of alternatives, a few rare words are ranked first. The k-th of these ranks is one that a chunk must
  reach, so the most frequent words, as far as they cannot reach it together, find no chunks of their own;
- chunks that a question of negations asks for are told within the scan of the chunks, of which every task keeps k.
"""

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repoindex.functions.sizing import MAX_BROADCAST_ROWS, small_side
from repoindex.functions.tokens import lexeme_array
from repoindex.operators.fulltext import (
    CANDIDATES, HIT_KEYS, INVERSE_SQUARES_LIMIT, WEIGHT, few_lexemes, fts_match, fts_rank, fts_topk, query_forms,
)
from repoindex.session import scratch_path, staged

SLOTS = 256
# Tasks that write a file into each slot, at most.
FILES_PER_SLOT = 256
# Bytes of the distinct ids of a file: with them each id is held once, whatever the number of its words in the file.
DISTINCT_IDS = 16 << 20
# Occurrences of rare words, per question, namespace and kind, that are ranked to find the rank to reach.
FIRST_ROWS = 50 * CANDIDATES
# Questions of negations that one scan of the chunks answers.
QUESTIONS_PER_SCAN = 4096
# Chunks, once per question that finds them, that are looked up in the postings of its other words; with more, the postings
# of all words are gathered by chunk, once each.
LOOKED_UP = MAX_BROADCAST_ROWS
# Ranks are single precision numbers; a bound must be passed by more than they are rounded.
MARGIN = 1e-5

_GROUP = ["namespace", "kind"]
_KEYS = [*_GROUP, "id"]


@dataclass
class TextIndex:
    """Postings (…, slot) and counts (namespace, kind, lexeme, chunks, most, slot) of them."""

    postings: DataFrame
    counts: DataFrame
    slots: int

    def where(self, condition: Column) -> "TextIndex":
        """The index of some namespaces or kinds."""
        return TextIndex(self.postings.where(condition), self.counts.where(condition), self.slots)


def slot_of(lexeme: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(slots)).cast("int")


def _by_slot(postings: DataFrame, slots: int) -> DataFrame:
    """Postings with their slot as every task writes them: sorted by slot and lexeme, not moved."""
    rows = postings.select(*_KEYS, "lexeme", "positions", slot_of(F.col("lexeme"), slots).alias("slot"))
    if rows.rdd.getNumPartitions() > FILES_PER_SLOT:
        rows = rows.coalesce(FILES_PER_SLOT)
    return rows.sortWithinPartitions("slot", "lexeme")


def write_text_index(postings: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Lay postings (namespace, kind, id, lexeme, positions) out by slot, sorted by lexeme, with their counts.

    Postings are not shuffled: each task writes a file into every slot, so a slot of a very frequent word is no task's, and the
    ids of a file are those of the chunks of one task, once each.
    """
    rows = _by_slot(postings, slots)
    # Ids are hashes, which the default codec leaves as long as they are.
    rows.write.option("compression", "zstd").option("parquet.dictionary.page.size", DISTINCT_IDS).partitionBy(
        "slot").parquet(f"{path}/lexemes")
    spark = postings.sparkSession
    stored = spark.read.schema(rows.schema).parquet(f"{path}/lexemes")
    counts = stored.groupBy(*_GROUP, "lexeme", "slot").agg(
        F.count(F.lit(1)).alias("chunks"), F.max(F.size("positions")).alias("most"))
    counts.hint("rebalance", "slot").sortWithinPartitions("slot", "lexeme").write.partitionBy("slot").parquet(
        f"{path}/counts")
    spark.range(1).select(F.lit(slots).alias("slots")).write.parquet(f"{path}/shape")


def read_text_index(spark: SparkSession, path: str) -> TextIndex:
    slots = spark.read.parquet(f"{path}/shape").first()["slots"]
    keys = "namespace string, kind string, lexeme string, slot int"
    return TextIndex(spark.read.schema(f"{keys}, id string, positions array<int>").parquet(f"{path}/lexemes"),
                     spark.read.schema(f"{keys}, chunks long, most int").parquet(f"{path}/counts"), slots)


def of_words(rows: DataFrame, words: list[str] | None, slots: int) -> DataFrame:
    """Rows of these lexemes: only their folders are read. None stands for too many words to list."""
    if words is None:
        return rows
    spark = rows.sparkSession
    listed = spark.createDataFrame([(w,) for w in words], "lexeme string")
    needed = sorted({row[0] for row in listed.select(slot_of(F.col("lexeme"), slots)).collect()})
    return rows.where(F.col("slot").isin(needed) & F.col("lexeme").isin(words))


# ---- which words find chunks ----

def _required(forms: DataFrame) -> DataFrame:
    """(query_id, group_no, lexeme): the words that a chunk must have to match this alternative of a question."""
    groups = forms.select("query_id", F.posexplode("groups").alias("group_no", "clauses"))
    clause = groups.select("query_id", "group_no", F.explode("clauses").alias("c")).where("NOT c.negated")
    return clause.select("query_id", "group_no", F.explode("c.words.lexeme").alias("lexeme")).distinct()


def rarest_words(forms: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, lexeme): of each alternative the required word that stands in the fewest chunks."""
    total = counts.groupBy("lexeme").agg(F.sum("chunks").alias("chunks"))
    known = _required(forms).join(total, "lexeme", "left")
    rank = F.struct(F.coalesce("chunks", F.lit(0)).alias("chunks"), "lexeme")
    return known.groupBy("query_id", "group_no").agg(F.min(rank).alias("least")).select(
        "query_id", F.col("least.lexeme").alias("lexeme")).distinct()


def _series(n: Column) -> Column:
    """Rank of a word that stands n times in a chunk, before it is divided by the question's words."""
    inverse = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda total, j: total + 1.0 / (j * j))
    return WEIGHT * inverse / INVERSE_SQUARES_LIMIT


def finding_words(index: TextIndex, forms: DataFrame, counts: DataFrame, words: list[str] | None, k: int) -> DataFrame:
    """(query_id, namespace, kind, lexeme) of questions of single alternative words: those that must find chunks.

    Ranks are sums over words, so what a chunk gets from the rarest words is a lower bound of its rank, and the k-th of
    these ranks in a namespace and kind is reached by k chunks. Words in descending order of frequency, as long as the
    best they can add up to stays below it, cannot bring a chunk among the k best without another word.
    """
    each = Window.partitionBy("query_id", *_GROUP)
    asked = forms.select("query_id", F.explode("terms").alias("lexeme"), F.size("terms").alias("n_terms"))
    known = counts.join(small_side(asked), "lexeme").withColumn("best", _series(F.col("most")) / F.col("n_terms"))
    known = known.withColumns({
        "earlier": F.sum("chunks").over(each.orderBy("chunks", "lexeme").rowsBetween(
            Window.unboundedPreceding, -1)),
        "reachable": F.sum("best").over(each.orderBy(F.desc("chunks"), F.desc("lexeme")).rowsBetween(
            Window.unboundedPreceding, 0))})
    path = scratch_path(index.postings.sparkSession, "words")
    known.select("query_id", *_GROUP, "lexeme", "n_terms", "earlier", "reachable").write.parquet(path)
    known = index.postings.sparkSession.read.parquet(path)
    first = known.where(F.coalesce("earlier", F.lit(0)) < FIRST_ROWS).select("query_id", *_GROUP, "lexeme", "n_terms")
    shares = of_words(index.postings, words, index.slots).join(small_side(first), [*_GROUP, "lexeme"]).select(
        *HIT_KEYS, (_series(F.size("positions")) / F.col("n_terms")).alias("share"))
    partial = shares.groupBy(*HIT_KEYS).agg(F.sum("share").alias("rank"))
    reached = fts_topk(partial, k).where(F.col("rn") == k).select("query_id", *_GROUP, F.col("rank").alias("bound"))
    bounded = known.join(small_side(reached), ["query_id", *_GROUP], "left")
    return bounded.where(F.col("bound").isNull() | (F.col("reachable") >= F.col("bound") * (1 - MARGIN))).select(
        "query_id", *_GROUP, "lexeme")


# ---- search ----

def _touched(postings: DataFrame, wanted: DataFrame, seeds: DataFrame) -> DataFrame:
    """Postings of the wanted words, but only in chunks that one of the question's seeds finds."""
    found = postings.join(small_side(seeds), [c for c in seeds.columns if c != "query_id"]).select(*HIT_KEYS).distinct()
    path = scratch_path(postings.sparkSession, "found")
    found.write.parquet(path)
    found = postings.sparkSession.read.schema(found.schema).parquet(path)
    rows = postings.join(small_side(wanted), "lexeme").select(*HIT_KEYS, "lexeme", "positions")
    return rows.join(small_side(found), HIT_KEYS, "left_semi")


def text_matches(index: TextIndex, clauses: DataFrame, k: int | None = None) -> DataFrame:
    """What ``fts_match`` finds in chunks that have a word of the question, from fewer rows.

    With ``k``, chunks may be missing that are not among the k best of their question, namespace and kind.
    """
    words = few_lexemes(clauses)
    postings, counts = (of_words(rows, words, index.slots) for rows in (index.postings, index.counts))
    wanted = clauses.select("query_id", "lexeme").distinct()
    forms = query_forms(clauses)
    # Alternatives of one word each are ranked by a sum, which has bounds; all others find chunks by their rarest words.
    summed = F.col("any_word") & ~F.col("ranked_by_distance")
    forms = staged(forms.withColumn("summed", summed & F.lit(k is not None)), "forms")
    # Where an alternative is of negations only, each chunk with any of the words may match.
    closed = forms.where("NOT summed AND NOT open_ended")
    seeds = [staged(rarest_words(closed, counts).unionByName(
        forms.where("open_ended").select("query_id", F.explode("terms").alias("lexeme"))), "seeds")]
    added = forms.where("summed")
    if not added.isEmpty():
        seeds.append(staged(finding_words(index, added, counts, words, k), "finding"))
    if words is not None and sum(_found_at_most(counts, part) for part in seeds) > LOOKED_UP:
        named = reduce(DataFrame.unionByName, [part.select("query_id", "lexeme") for part in seeds]).distinct()
        return fts_match(postings, clauses, seeds={(row["query_id"], row["lexeme"]) for row in named.collect()})
    rows = reduce(DataFrame.unionByName, [_touched(postings, wanted, part) for part in seeds])
    return fts_match(rows, clauses, gathered=True)


def _found_at_most(counts: DataFrame, seeds: DataFrame) -> int:
    """How often the seeds stand in chunks, each counted for every question."""
    on = [c for c in seeds.columns if c != "query_id"]
    return counts.join(small_side(seeds), on).agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]


def untouched_topk(chunks: DataFrame, clauses: DataFrame, k: int, config: str) -> DataFrame:
    """Chunks that have no word of a question that matches such: the k smallest ids per question, namespace and kind.

    ``chunks`` has (namespace, kind, id, text). Whether a chunk has a word is told from its own lexemes, and a task keeps
    k ids, so no more than k rows per task and question leave the scan. These chunks all rank zero.
    """
    open_ended = query_forms(clauses).where("open_ended").select("query_id", "terms")
    path = scratch_path(chunks.sparkSession, "open-questions")
    open_ended.write.parquet(path)
    open_ended = chunks.sparkSession.read.schema(open_ended.schema).parquet(path)
    parts = -(-open_ended.count() // (QUESTIONS_PER_SCAN // 2)) or 1
    place = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    scans = [_untouched_by(chunks, open_ended.where(place == n), k, config) for n in range(parts)]
    return reduce(DataFrame.unionByName, scans).withColumn("rank", F.lit(0.0))


def _untouched_by(chunks: DataFrame, open_ended: DataFrame, k: int, config: str) -> DataFrame:
    asked = [(row["query_id"], frozenset(row["terms"])) for row in open_ended.toLocalIterator()]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[str]] = {}
        for batch in batches:
            names = zip(*(batch.column(n).to_pylist() for n in range(3)))
            for row, (namespace, kind, name) in enumerate(names):
                lexemes = None
                for query_id, terms in asked:
                    ids = best.setdefault((query_id, namespace, kind), [])
                    if len(ids) == k and name >= ids[-1]:
                        continue
                    lexemes = batch.column(3)[row].as_py() if lexemes is None else lexemes
                    if terms.isdisjoint(lexemes):
                        insort(ids, name)
                        del ids[k:]
        rows = [(*key, name) for key, ids in best.items() for name in ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[n] for row in rows], kind) for n, kind in enumerate([pa.int64(), *[pa.string()] * 3])],
            names=HIT_KEYS)

    rows = chunks.select(*_KEYS, F.array_distinct(lexeme_array(F.col("text"), config)).alias("lexemes"))
    return rows.mapInArrow(keep, "query_id long, namespace string, kind string, id string")


def text_topk(index: TextIndex, clauses: DataFrame, k: int = CANDIDATES, chunks: DataFrame | None = None,
              config: str = "english") -> DataFrame:
    """The k best chunks of each question per namespace and kind, as ``fts_topk`` of all matches has them.

    Questions that chunks without any of their words match take these from ``chunks``; without it they are left out.
    """
    ranked = fts_rank(text_matches(index, clauses, k))
    if chunks is not None and not query_forms(clauses).where("open_ended").isEmpty():
        ranked = ranked.unionByName(untouched_topk(chunks, clauses, k, config))
    return fts_topk(ranked, k)
