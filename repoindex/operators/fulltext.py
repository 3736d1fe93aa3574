"""Full-text questions: clauses, match and rank over the postings table."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from repoindex.functions.sizing import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS
from repoindex.functions.tokens import lexeme_array

# The rank formula.
WEIGHT = 0.1
INVERSE_SQUARES_LIMIT = 1.64493406685
FAR_DISTANCE = 100
FAR_WEIGHT = 1e-30
CANDIDATES = 20

PUSHED_LEXEMES = 1000
# Entries of chunks, counted once per question that asks for them, that a task holds at a time; one chunk may have more.
ENTRIES_AT_A_TIME = 1 << 18

CHUNK_KEYS = ["namespace", "kind", "id"]
HIT_KEYS = ["query_id", *CHUNK_KEYS]

# A question item: an optionally negated quoted phrase (the last quote may be missing), or a run of non-spaces.
_ITEM = r'(-?"[^"]*"?|[^\s"]+)'


def _items(question: Column) -> Column:
    """Items of a question as ARRAY<STRUCT<raw, or_group>>, with the operators ``or`` taken out.

    An ``or`` between two items separates groups; where an operand is due, and at the very end, it is a word.
    """
    raw = F.regexp_extract_all(question, F.lit(_ITEM), 1)
    state = F.struct(
        F.expr("CAST(array() AS ARRAY<STRUCT<raw: STRING, or_group: INT>>)").alias("items"),
        F.lit(0).alias("or_group"), F.lit(True).alias("operand_due"), F.lit(1).alias("at"),
    )

    def step(acc: Column, item: Column) -> Column:
        operator = ~acc["operand_due"] & (F.lower(item) == "or") & (acc["at"] < F.size(raw))
        taken = F.array_append(acc["items"], F.struct(item.alias("raw"), acc["or_group"].alias("or_group")))
        return F.struct(
            F.when(operator, acc["items"]).otherwise(taken).alias("items"),
            F.when(operator, acc["or_group"] + 1).otherwise(acc["or_group"]).alias("or_group"),
            operator.alias("operand_due"), (acc["at"] + 1).alias("at"),
        )

    return F.aggregate(raw, state, step, lambda acc: acc["items"])


def query_clauses(queries: DataFrame, config: str = "english") -> DataFrame:
    """(query_id, or_group, clause_id, lexeme, offset, negated) of a table (query_id, question).

    Bare words are AND-ed, ``"…"`` is a phrase, ``or`` separates alternatives, ``-`` negates. A word that
    yields several tokens is a phrase of them. Clauses of stop words only are dropped.
    """
    items = queries.select("query_id", F.posexplode(_items(F.col("question"))).alias("clause_id", "item"))
    words = items.select(
        "query_id", F.col("item.or_group").alias("or_group"), "clause_id",
        F.startswith(F.col("item.raw"), F.lit("-")).alias("negated"),
        F.posexplode(lexeme_array(F.col("item.raw"), config)).alias("offset", "lexeme"),
    )
    return words.where("lexeme IS NOT NULL").select(
        "query_id", "or_group", "clause_id", "lexeme", "offset", "negated")


def query_forms(clauses: DataFrame) -> DataFrame:
    """One row per question: its clauses as ``groups``, its distinct lexemes, and which rank formula holds.

    Groups here are as long as one question.
    """
    by_clause = clauses.groupBy("query_id", "or_group", "clause_id", "negated").agg(
        F.array_sort(F.collect_list(F.struct("offset", "lexeme"))).alias("words"))
    by_group = by_clause.groupBy("query_id", "or_group").agg(
        F.collect_list(F.struct("negated", "words")).alias("clauses"))
    forms = by_group.groupBy("query_id").agg(F.collect_list("clauses").alias("groups"))
    terms = F.array_distinct(F.flatten(F.transform(
        F.flatten("groups"), lambda c: F.transform(c["words"], lambda w: w["lexeme"]))))
    only_negation = (F.size(F.flatten("groups")) == 1) & F.element_at(F.flatten("groups"), 1)["negated"]
    return forms.select(
        "query_id", "groups", terms.alias("terms"),
        ((F.size("groups") == 1) & (F.size(terms) > 1) & ~only_negation).alias("ranked_by_distance"),
        F.exists("groups", lambda g: F.forall(g, lambda c: c["negated"])).alias("open_ended"),
        # Alternatives of one word each: whatever has a word of the question matches.
        F.forall("groups", lambda g: (F.size(g) == 1) & F.forall(
            g, lambda c: ~c["negated"] & (F.size(c["words"]) == 1))).alias("any_word"),
    )


def _clause_holds(words: Column, found: Column) -> Column:
    """A word, or a phrase: some position of its first word from which all others stand at their offsets."""
    first = F.element_at(words, 1)
    return F.exists(
        F.coalesce(F.try_element_at(found, first["lexeme"]), F.array().cast("array<int>")),
        lambda p: F.forall(words, lambda w: F.coalesce(
            F.array_contains(F.try_element_at(found, w["lexeme"]), p + w["offset"] - first["offset"]),
            F.lit(False))),
    )


def few_lexemes(clauses: DataFrame) -> list[str] | None:
    """The distinct lexemes of the questions if the clause table is small enough to be broadcast, else None."""
    words = [row[0] for row in clauses.select("lexeme").take(MAX_BROADCAST_ROWS + 1)]
    if len(words) > MAX_BROADCAST_ROWS or sum(map(len, words)) > MAX_BROADCAST_BYTES // 4:
        return None
    return sorted(set(words))


def _asked_of_chunks(chunks: DataFrame, forms: DataFrame, seeds: set[tuple] | None) -> DataFrame:
    """(hit keys, entries): each chunk (namespace, kind, id, listed, entries) once per question that has one of its lexemes,
    with the entries of these by lexeme; a ``listed`` chunk also for every open-ended question, with or without any.

    With ``seeds`` (query_id, lexeme) a question takes only chunks that have one of its seeds. Chunks meet the questions
    within the task, a bounded number of entries at a time, so nothing is shuffled or sorted once per question.
    """
    asked = forms.where("query_id IS NOT NULL").select("query_id", "terms", "open_ended").collect()
    words = sorted({word for row in asked for word in row["terms"]})
    number = {word: n for n, word in enumerate(words)}
    pairs = sorted((number[word], n) for n, row in enumerate(asked) for word in row["terms"])
    word_of, question_of = np.array(pairs, np.int64).reshape(-1, 2).T
    starts = np.searchsorted(word_of, np.arange(len(words) + 1))
    finds = np.array([seeds is None or (asked[n]["query_id"], words[w]) in seeds for w, n in pairs], bool)
    open_ended = np.flatnonzero([row["open_ended"] for row in asked])
    fields = [forms.schema["query_id"], *(chunks.schema[c] for c in CHUNK_KEYS)]
    query_ids = pa.array([row["query_id"] for row in asked], to_arrow_type(fields[0].dataType))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch["entries"]), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            flat = batch["entries"].flatten()
            lexemes = flat.field("lexeme")
            code = pc.index_in(lexemes, value_set=pa.array(words, lexemes.type)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            listed = batch["listed"].to_numpy(zero_copy_only=False)
            times = np.diff(starts)[code]
            done = np.bincount(row, times, batch.num_rows) + listed * len(open_ended)
            turn = np.cumsum(done) // ENTRIES_AT_A_TIME
            for first in np.unique(turn, return_index=True)[1]:
                last = np.searchsorted(turn, turn[first], side="right")
                own = slice(ends[first] - lengths[first], ends[last - 1])
                yield take(batch, flat, code, row, listed, times, own, np.arange(first, last))

    def take(batch, flat, code, row, listed, times, own, lines) -> pa.RecordBatch:
        entry = np.repeat(np.arange(own.start, own.stop), times[own])
        nth = np.arange(len(entry)) - np.repeat(np.cumsum(times[own]) - times[own], times[own])
        pair = starts[code[entry]] + nth
        # Open-ended questions of listed chunks come without an entry.
        free = lines[listed[lines]]
        line = np.concatenate([row[entry], np.repeat(free, len(open_ended))])
        question = np.concatenate([question_of[pair], np.tile(open_ended, len(free))])
        found = np.concatenate([finds[pair], np.ones(len(line) - len(pair), bool)])
        word = np.concatenate([code[entry], np.full(len(line) - len(pair), -1)])
        entry = np.concatenate([entry, np.full(len(line) - len(pair), -1)])
        order = np.argsort(((line - lines[0]) * len(asked) + question) * (len(words) + 1) + word, kind="stable")
        line, question, found, entry = line[order], question[order], found[order], entry[order]
        opens = np.ones(len(line), bool)
        opens[1:] = (line[1:] != line[:-1]) | (question[1:] != question[:-1])
        start = np.flatnonzero(opens)
        kept = np.logical_or.reduceat(found, start) if len(start) else opens
        group = np.cumsum(opens) - 1
        held = kept[group] & (entry >= 0) if len(start) else opens
        sizes = np.bincount(group[held], minlength=len(start))[kept]
        start = start[kept]
        entries = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat.take(pa.array(entry[held])))
        keys = [batch[c].take(pa.array(line[start])) for c in CHUNK_KEYS]
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(question[start])), *keys, entries],
                                          names=[*HIT_KEYS, "entries"])

    schema = T.StructType([*fields, chunks.schema["entries"]])
    return chunks.select(*CHUNK_KEYS, "listed", "entries").mapInArrow(expand, schema)


def _shuffled_per_question(postings: DataFrame, clauses: DataFrame, forms: DataFrame, universe: DataFrame | None,
                           gathered: bool) -> DataFrame:
    """(hit keys, entries) where the questions are too many for every task, or the postings already those of each."""
    touched = postings
    if not gathered:
        wanted = clauses.select("query_id", "lexeme").distinct()
        touched = postings.join(wanted, "lexeme").select(*HIT_KEYS, "lexeme", "positions")
    if universe is not None and not forms.where("open_ended").isEmpty():
        salt = F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")
        open_ended = forms.where("open_ended").select(
            "query_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("part"))
        everything = (
            universe.select("namespace", "kind", "id", salt.alias("part")).join(open_ended, "part")
            .select(*HIT_KEYS, F.lit(None).cast("string").alias("lexeme"),
                    F.lit(None).cast("array<int>").alias("positions"))
        )
        touched = touched.unionByName(everything)
    return touched.groupBy(*HIT_KEYS).agg(F.array_sort(_entries()).alias("entries"))


def _entries() -> Column:
    return F.collect_list(F.when(F.col("lexeme").isNotNull(), F.struct("lexeme", "positions")))


def fts_match(postings: DataFrame, clauses: DataFrame, universe: DataFrame | None = None,
              gathered: bool = False, seeds: set[tuple] | None = None) -> DataFrame:
    """Matching chunks of every question: hit keys, ``found`` (lexeme → positions), terms and rank formula.

    The postings of the words asked for, once each however many questions ask for them, are shuffled by chunk. A chunk
    then meets its questions where it is: a row for each, with what it has of the question's lexemes, on which the boolean
    form is evaluated, so phrases and negations need no joins of their own. The lexemes of few questions also go to the scan
    as a filter: stored postings are sorted by lexeme, so it can skip row groups. A question with an alternative made of
    negations only matches chunks that have none of its lexemes: those come from ``universe`` (namespace, kind, id).
    Postings that already are those of each question, with its query_id, are ``gathered``. With ``seeds`` (query_id, lexeme)
    a question is only asked of chunks that have one of its seeds.
    """
    words = few_lexemes(clauses)
    # Both sides marked here have at most as many rows as there are clauses, and the same words in them.
    mark = (lambda df: df) if words is None else F.broadcast
    if words is not None and len(words) <= PUSHED_LEXEMES:
        postings = postings.where(F.col("lexeme").isin(words))
    forms = query_forms(clauses)
    if gathered or words is None:
        rows = _shuffled_per_question(postings, clauses, forms, universe, gathered)
    else:
        asked = postings.join(F.broadcast(clauses.select("lexeme").distinct()), "lexeme", "left_semi").select(
            *CHUNK_KEYS, "lexeme", "positions", F.lit(False).alias("listed"))
        if universe is not None:
            asked = asked.unionByName(universe.select(
                *CHUNK_KEYS, F.lit(None).cast("string").alias("lexeme"),
                F.lit(None).cast(asked.schema["positions"].dataType).alias("positions"), F.lit(True).alias("listed")))
        chunks = asked.repartition(*CHUNK_KEYS).groupBy(*CHUNK_KEYS).agg(
            F.max("listed").alias("listed"), _entries().alias("entries"))
        rows = _asked_of_chunks(chunks, forms, seeds)
    judged = rows.select(*HIT_KEYS, F.map_from_entries("entries").alias("found")).join(mark(forms), "query_id")
    holds = F.exists("groups", lambda g: F.forall(
        g, lambda c: c["negated"] != _clause_holds(c["words"], F.col("found"))))
    return judged.where(F.col("any_word") | holds).select(*HIT_KEYS, "found", "terms", "ranked_by_distance")


def _frequency_rank(found: Column, terms: Column) -> Column:
    """``found`` has words of the question only, in one order for all chunks."""
    def of_word(positions: Column) -> Column:
        n = F.size(positions)
        series = F.aggregate(
            F.sequence(F.lit(1), n), F.lit(0.0), lambda total, j: total + 1.0 / (j * j))
        return F.when(n > 0, WEIGHT * F.when(n == 1, 1.0).otherwise(series) / INVERSE_SQUARES_LIMIT).otherwise(0.0)

    total = F.aggregate(F.map_values(found), F.lit(0.0), lambda acc, positions: acc + of_word(positions))
    return total / F.size(terms)


def _distance_rank(found: Column, terms: Column) -> Column:
    """1 - Π(1 - c) over position pairs of different terms, as a sum of logarithms within the row."""
    def pair_log(distance: Column) -> Column:
        near = 1.0 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2.0))
        strength = F.when(distance > FAR_DISTANCE, FAR_WEIGHT).otherwise(near)
        return F.when(distance == 0, 0.0).otherwise(F.log1p(-WEIGHT * F.sqrt(strength)))

    def positions(term: Column) -> Column:
        return F.coalesce(F.try_element_at(found, term), F.array().cast("array<int>"))

    def of_pair(left: Column, right: Column) -> Column:
        return F.aggregate(positions(left), F.lit(0.0), lambda outer, p: outer + F.aggregate(
            positions(right), F.lit(0.0), lambda inner, q: inner + pair_log(F.abs(p - q))))

    def with_earlier(term: Column, index: Column) -> Column:
        return F.aggregate(F.slice(terms, F.lit(1), index), F.lit(0.0),
                           lambda acc, earlier: acc + of_pair(term, earlier))

    logs = F.aggregate(F.transform(terms, with_earlier), F.lit(0.0), lambda acc, x: acc + x)
    return -F.expm1(logs)


def fts_rank(matches: DataFrame) -> DataFrame:
    """Hit keys and ``rank``, of single precision so that equal formulas tie; words far apart still rank above zero."""
    found, terms = F.col("found"), F.col("terms")
    rank = F.when(F.col("ranked_by_distance"), _distance_rank(found, terms)).otherwise(
        _frequency_rank(found, terms))
    return matches.select(*HIT_KEYS, rank.cast("float").cast("double").alias("rank"))


def fts_topk(ranked: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k best text hits per question, namespace and kind, numbered from 1."""
    order = Window.partitionBy("query_id", "namespace", "kind").orderBy(F.desc("rank"), "id")
    return ranked.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
