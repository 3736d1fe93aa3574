"""How filters of a corpus interact: what each removes in every order, and its Shapley share, from one table of counts.

Each document becomes the set of filters it fails, a number of n bits. What a coalition of filters removes is a sum over
these sets, so all 2^n coalitions of a part of the corpus come from one count per set. Everything else follows from them:
a step of an order removes the difference of two coalitions, and the Shapley shares are the exact minimum of the
kernel-weighted squares of all coalitions under the efficiency constraint, solved in rationals.
"""

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoindex.llm.batches import staged

# The filters in order, and what makes a document fail them.
FILTERS = "ABCDE"
LEAST_WORDS = 200
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are no white space."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1), "")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A to D: few words, repeated words, capitals, symbols."""
    words = words_of(text)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [F.size(words) < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            100 * capitals > 2 * F.length(text), text.rlike(SYMBOLS)]


def _bits(failures: list[Column]) -> Column:
    total = F.lit(0)
    for place, failed in enumerate(failures):
        total = total + F.when(failed, 1 << place).otherwise(0)
    return total


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents of each source by the set of filters they fail, bit 0 for A.

    A null text is empty, a null source the empty part. E fails where a smaller doc_id has an identical text; a null
    doc_id is neither smaller nor larger than another, so it never fails E. Rows that share doc_id and text have no
    smaller one among them. A document is good (toxic) if one of the label rows of its doc_id is; labels with a null
    doc_id belong to nobody. Each row counts as a document. Other columns are not read. An empty table gives no rows.

    Texts are read once; a text then is its SHA-256. The first doc_id of each text is a minimum that every task
    forms on its own, and meets the documents by doc_id and text, so a group of copies is spread by its ids.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(docs.select(
        F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), _bits(text_failures(body)).alias("failed"),
        F.unhex(F.sha2(body, 256)).alias("text_key")), "filter-failures")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    firsts = rows.where("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    named = rows.where("doc_id IS NOT NULL").join(
        firsts.withColumn("first", F.lit(True)), ["doc_id", "text_key"], "left").join(marks, "doc_id", "left")
    again = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    named = named.select("part", (F.col("failed") + again).alias("failed"), "good", "toxic")
    nameless = rows.where("doc_id IS NULL").select(
        "part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return named.unionByName(nameless).groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def coalition_removals(counts: DataFrame, filters: int, weights: list[str]) -> DataFrame:
    """One row per part with its number of documents, total, and an array for each weight: what coalition 0, 1, …
    2^filters - 1 removes of it.

    ``counts`` has one row per part and set of failed filters; a part is at most 2^filters rows.
    """
    sums = [F.sum(F.when(F.col("failed").bitwiseAND(F.lit(s)) != 0, F.col(w)).otherwise(0)).alias(f"_{w}_{s}")
            for w in weights for s in range(1 << filters)]
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"), *sums)
    return totals.select("part", "total", *[
        F.array(*[F.col(f"_{w}_{s}") for s in range(1 << filters)]).alias(w) for w in weights])


def _solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """matrix⁻¹ · right by elimination without rounding."""
    size = len(matrix)
    rows = [list(a) + list(b) for a, b in zip(matrix, right, strict=True)]
    for at in range(size):
        pivot = next(r for r in range(at, size) if rows[r][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for r in range(size):
            if r != at and rows[r][at]:
                factor = rows[r][at]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[at], strict=True)]
    return [row[size:] for row in rows]


def shapley_solution(players: int) -> list[list[Fraction]]:
    """The shares as a linear map of the removals: shares[i] = sum over coalitions s of map[i][s] * removed[s].

    Least squares over all coalitions but the empty and the whole one, weighted by the Shapley kernel, under the
    constraint that the shares add up to what the whole coalition removes. The normal equations with the
    constraint's multiplier are a system of players + 1 rationals, and its right side is linear in the removals.
    """
    sets = range(1 << players)
    whole = (1 << players) - 1
    weight = [Fraction(0)] * (1 << players)
    for s in sets:
        if 0 < s < whole:
            size = s.bit_count()
            weight[s] = Fraction(players - 1, comb(players, size) * size * (players - size))

    def has(s: int, i: int) -> int:
        return s >> i & 1

    normal = [[sum((weight[s] * has(s, i) * has(s, j) for s in sets), Fraction(0)) for j in range(players)]
              + [Fraction(1)] for i in range(players)]
    normal.append([Fraction(1)] * players + [Fraction(0)])
    right = [[weight[s] * has(s, i) for s in sets] for i in range(players)]
    right.append([Fraction(int(s == whole)) for s in sets])
    return _solve(normal, right)[:players]


def _at(array: str, coalition: Column) -> Column:
    return F.get(F.col(array), coalition)


def audit_orders(removals: DataFrame, letters: str = FILTERS) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``removals`` has arrays n, good and toxic by coalition and the part's number of documents, total. shapley is the
    share times the number of orders: what the step's filter removes, summed over all orders.
    """
    players, orders = len(letters), factorial(len(letters))
    shares = []
    for row in shapley_solution(players):
        scaled = [orders * x for x in row]
        assert all(x.denominator == 1 for x in scaled)
        shares.append(sum((F.lit(int(x)) * F.get("n", F.lit(s)) for s, x in enumerate(scaled) if x),
                          F.lit(0).cast("long")))
    listed = F.split(F.lit(",".join("".join(order) for order in permutations(letters))), ",")
    steps = removals.withColumn("_shares", F.array(*shares)).select(
        "*", F.explode(listed).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(players))).alias("step"))
    letter = F.expr("substring(filter_order, step, 1)")
    bits = F.create_map(*[x for place, name in enumerate(letters) for x in (F.lit(name), F.lit(1 << place))])
    before = sum((F.when(F.instr("filter_order", name) < F.col("step"), 1 << place).otherwise(0)
                  for place, name in enumerate(letters)), F.lit(0))
    whole = F.lit((1 << players) - 1)
    steps = steps.withColumns({"_before": before, "_own": bits[letter], "_place": F.instr(F.lit(letters), letter) - 1})
    steps = steps.withColumn("_after", F.col("_before") + F.col("_own"))
    removed = _at("n", F.col("_after")) - _at("n", F.col("_before"))
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - _at("n", F.col("_after"))).alias("kept"),
        removed.alias("removed"), (_at("n", F.col("_own")) - removed).alias("redundant"),
        (_at("n", whole) - _at("n", whole - F.col("_own"))).alias("unique_fails"),
        (_at("good", F.col("_after")) - _at("good", F.col("_before"))).alias("good_lost"),
        (_at("toxic", F.col("_after")) - _at("toxic", F.col("_before"))).alias("toxic_lost"),
        F.get("_shares", F.col("_place")).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters per source: 600 rows for each part that has a document; see ``failure_counts`` for
    what counts as failing and how nulls and repeated rows count."""
    counts = failure_counts(docs, labels)
    return audit_orders(coalition_removals(counts, len(FILTERS), ["n", "good", "toxic"]))
