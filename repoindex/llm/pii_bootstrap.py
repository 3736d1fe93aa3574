"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers they miss; columns only.

Spans of the base patterns are the seeds, and so are long keys of letters and digits, a kind of their own that is no span
by itself. The words before and after a seed are its lexical patterns; whatever looks like an identifier and stands next
to such a word is a candidate instance. Patterns and instances form a graph. A pattern's confidence is the score of the
instances that stand with its word, over all occurrences of the word in the corpus; an instance's score is the chance
that one of its confident patterns is right. Instances of high score induce patterns of their own, in turn, until no
score changes. Those that are sure in the end become spans.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoindex.functions.sizing import small_side
from repoindex.llm.batches import staged

# The kinds in order, and their patterns. Possessive forms and the anchors before them find the same
# spans in linear time.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Kinds of spans that only the method finds.
SECRET = "secret"
ALL_KINDS = [*KINDS, SECRET]
SPACE = r"\x20\x09-\x0D"
# A word with four digits or an at sign, and the groups of digits that follow it, each after one blank.
_FOUR_DIGITS = rf"[^{SPACE}0-9]*+[0-9](?:[^{SPACE}0-9]*+(?:\x20[(+]?)?[0-9]){{3}}"
CANDIDATE = (rf"(?<![^{SPACE}])(?=[^{SPACE}@]*+@|{_FOUR_DIGITS})[^{SPACE}]++"
             rf"(?:\x20[(+]?[0-9][0-9().,;:/-]*+(?![^{SPACE}]))*+")
SECRET_SEED = r"^(?=(?:[^0-9]*[0-9]){4})(?=.*[A-Za-z])[A-Za-z0-9_-]{20,}$"
# Words of contexts, whatever punctuation stands between them and the identifier.
WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
LAST_WORD = rf"(?<![{WORD}])([{WORD}]++)[^{WORD}]*+$"
NEXT_WORD = rf"^[^{WORD}]*+([{WORD}]++)"

# Distinct instances that a pattern needs, candidates' least digits, the confidence from which a pattern is evidence, the
# score from which an instance is a span, and the change of a score that counts as none.
LEAST_SEEDS = 3
LEAST_DIGITS = 4
EVIDENCE = 0.5
CONFIDENT = 0.8
SETTLED = 0.005
SMOOTHING = 0.5
# Spans that are appended to one array before it is closed.
CHUNK = 1000
# Characters on either side in which the neighbouring word is looked for first.
NEAR = 200

SPAN = "struct<start:bigint,end:bigint,value:string,before:string,after:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is one of the kind."""
    if kind == "ip":
        parts = F.split(value, r"\.")
        return F.forall(parts, lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (
            F.coalesce(F.regexp_replace(part, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _valid_spans(kind: str):
    return lambda span: is_valid(kind, span["value"])


def _word_before(piece: Column) -> Column:
    """The last word of the text before a span; the whole of it is searched only where its end does not show it."""
    end = F.substring(piece, -NEAR, NEAR)
    cut = (F.length(piece) > NEAR) & ~end.rlike(rf"[^{WORD}][{WORD}]++[^{WORD}]*+$")
    return F.lower(F.regexp_extract(F.when(cut, piece).otherwise(end), LAST_WORD, 1))


def _word_after(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, NEXT_WORD, 1))


def _locate(pieces: Column, matches: Column) -> Column:
    """Where matches lie, from the pieces between them: lengths summed up, some at a time."""
    no_spans = F.array().cast(f"array<{SPAN}>")

    def one(state, at):
        start = state["pos"] + F.length(pieces[at])
        end = start + F.length(matches[at])
        span = F.struct(start.alias("start"), end.alias("end"), matches[at].alias("value"),
                        _word_before(pieces[at]).alias("before"), _word_after(pieces[at + 1]).alias("after"))
        return F.struct(end.alias("pos"), F.array_append(state["spans"], span).alias("spans"))

    def chunk(state, first):
        last = F.least(first + CHUNK, F.size(matches)) - 1
        done = F.aggregate(F.sequence(first, last),
                           F.struct(state["pos"].alias("pos"), no_spans.alias("spans")), one)
        return F.transform(F.array(done), lambda d: F.struct(
            d["pos"].alias("pos"), F.array_append(state["chunks"], d["spans"]).alias("chunks")))[0]

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<array<{SPAN}>>").alias("chunks"))
    chunks = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1, F.lit(CHUNK)), start, chunk)["chunks"]
    return F.when(F.size(matches) > 0, F.flatten(chunks)).otherwise(no_spans)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans_<kind>`` for each kind and ``candidates``: arrays of start, end (exclusive), value and context.

    Positions count code points. A null text counts as empty and has none.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    digit = body.rlike("[0-9]")
    gates = {"email": F.contains(body, F.lit("@")), "ip": digit, "card": digit,
             "phone": F.contains(body, F.lit("+")) & digit, "candidate": digit | F.contains(body, F.lit("@"))}
    for kind, pattern in [*PATTERNS.items(), ("candidate", CANDIDATE)]:
        no_text = F.array().cast("array<string>")
        docs = docs.withColumns({
            "_pieces": F.when(gates[kind], F.split(body, pattern, -1)).otherwise(no_text),
            "_matches": F.when(gates[kind], F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(no_text)})
        docs = docs.withColumn("_found", _locate(F.col("_pieces"), F.col("_matches")))
        if kind == "candidate":
            docs = docs.withColumn("candidates", F.filter(F.transform("_found", _trimmed), lambda s: (
                F.length(_digits(s["value"])) >= LEAST_DIGITS) | F.contains(s["value"], F.lit("@"))))
        else:
            docs = docs.withColumn(f"spans_{kind}", F.filter("_found", _valid_spans(kind)))
    return docs.drop("_pieces", "_matches", "_found")


def _trimmed(span: Column) -> Column:
    """The candidate without punctuation around it."""
    left = F.length(F.regexp_extract(span["value"], "^[^A-Za-z0-9+]*+", 0))
    value = F.regexp_replace(span["value"], "^[^A-Za-z0-9+]++|(?<![^A-Za-z0-9])[^A-Za-z0-9]++$|[^A-Za-z0-9]++$", "")
    start = span["start"] + left
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
                    span["before"].alias("before"), span["after"].alias("after"))


def _contexts(spans: Column) -> Column:
    """Two patterns per span: the word before and the word after; none at the text's ends and beside another span."""
    def sides(span):
        return F.array(F.struct(F.lit("before").alias("side"), span["before"].alias("word"), span["value"].alias("value")),
                       F.struct(F.lit("after").alias("side"), span["after"].alias("word"), span["value"].alias("value")))

    return F.filter(F.flatten(F.transform(spans, sides)), lambda c: c["word"] != "")


def _edges(found: DataFrame, spans: str) -> DataFrame:
    return found.select(F.explode(_contexts(F.col(spans))).alias("c")).groupBy("c.side", "c.word", "c.value").agg(
        F.count(F.lit(1)).alias("n"))


_PATTERN = ["kind", "side", "word"]


def score_graph(seeds: DataFrame, edges: DataFrame, words: DataFrame, least_seeds: int = LEAST_SEEDS,
                confident: float = CONFIDENT) -> DataFrame:
    """(value, kind, score) of the instances in ``edges`` (side, word, value, n), staged.

    ``seeds`` are edges of known instances, with their kind, whose score is one; ``words`` (word, word_n) counts all
    occurrences. Only patterns that have ``least_seeds`` seeds or confident instances and more than half of whose
    occurrences are instances, by their scores, are evidence. Scores only rise, and rise by at most half of what is
    left of a pattern's occurrences, so the turns end when they have settled.
    """
    own = seeds.groupBy(*_PATTERN).agg(F.count(F.lit(1)).alias("seeds"), F.sum("n").alias("seed_n"))
    own = staged(own, "pii-patterns")
    scores, before = None, None
    while True:
        known = own
        if scores is not None:
            # A seed of its own kind is counted as a seed already.
            gained = edges.join(scores, "value").join(seeds.select("value", "kind").distinct(), ["value", "kind"], "left_anti")
            gained = gained.groupBy(*_PATTERN).agg(
                F.count_if(F.col("score") >= confident).alias("sure"), F.sum(F.col("n") * F.col("score")).alias("gain"))
            known = own.join(gained, _PATTERN, "full_outer")
        else:
            known = known.withColumns({"sure": F.lit(0), "gain": F.lit(0.0)})

        def number(name):
            return F.coalesce(name, F.lit(0))

        patterns = known.where(number("seeds") + number("sure") >= least_seeds).join(words, "word").select(
            *_PATTERN, F.least((number("seed_n") + number("gain")) / (F.col("word_n") + SMOOTHING), F.lit(0.999)).alias("conf"))
        patterns = patterns.where(F.col("conf") >= EVIDENCE)
        scores = staged(edges.join(patterns, ["side", "word"]).groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score")), "pii-scores")
        now = scores.agg(F.count(F.lit(1)), F.count_if(F.col("score") >= confident), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if before is not None and now[:2] == before[:2] and now[2] - before[2] <= SETTLED * max(now[0], 1):
            return scores
        before = now


def discover(found: DataFrame, docs: DataFrame, text: str = "text", least_seeds: int = LEAST_SEEDS,
             confident: float = CONFIDENT) -> DataFrame:
    """(value, kind) of identifiers that confident patterns find and no base pattern does; found is staged base spans."""
    seeds = None
    for kind in KINDS:
        part = _edges(found, f"spans_{kind}").withColumn("kind", F.lit(kind))
        seeds = part if seeds is None else seeds.unionByName(part)
    known = staged(seeds.select("value").distinct(), "pii-seeds")
    edges = staged(_edges(found, "candidates").join(known, "value", "left_anti"), "pii-edges")
    seeds = staged(seeds.unionByName(edges.where(F.col("value").rlike(SECRET_SEED)).withColumn("kind", F.lit(SECRET))),
                   "pii-seeds")
    # A word next to fewer identifiers can never be a pattern.
    possible = edges.unionByName(seeds.where(F.col("kind") != SECRET).drop("kind")).groupBy("side", "word").agg(
        F.count(F.lit(1)).alias("values")).where(F.col("values") >= least_seeds)
    words = staged(possible.select("word").distinct(), "pii-words")
    if words.isEmpty() or seeds.isEmpty():
        return seeds.select("value", "kind").limit(0)
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    counts = staged(docs.select(F.explode(F.split(body, rf"[^{WORD}]+")).alias("word")).join(
        small_side(words), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("word_n")), "pii-words")
    edges = staged(edges.join(counts.select("word"), "word", "left_semi"), "pii-edges")
    scores = score_graph(seeds, edges, counts, least_seeds, confident)
    order = F.array_position(F.array(*[F.lit(kind) for kind in ALL_KINDS]), F.col("kind"))
    best = scores.where(F.col("score") >= confident).groupBy("value").agg(
        F.min(F.struct((-F.col("score")).alias("s"), order.alias("o"), "kind")).alias("best"))
    return best.select("value", "best.kind")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row (doc_id, base, added) per document: arrays of (start, kind number, end), sorted.

    Base spans come from the fixed patterns; added ones are occurrences of identifiers that confident contexts
    discover over all documents and that overlap no base span. Null texts are empty and have no spans; every row is
    handled by itself, so repeated rows and ids are fine; an empty table gives an empty one. Spans without texts are
    staged in the shared folder.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = staged(base_spans(rows).drop("text").withColumn("row", F.monotonically_increasing_id()), "pii-spans")
    added = discover(found, rows, **options)

    def triples(number, spans):
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    based = found.withColumn("base", F.array_sort(F.concat(
        *[triples(n, F.col(f"spans_{kind}")) for n, kind in enumerate(KINDS)])))
    numbers = F.create_map(*[x for n, kind in enumerate(ALL_KINDS) for x in (F.lit(kind), F.lit(n))])
    more = found.select("row", F.explode("candidates").alias("c")).select("row", "c.value", "c.start", "c.end").join(
        small_side(added), "value").groupBy("row").agg(F.collect_list(F.struct(
            "start", numbers[F.col("kind")].alias("kind"), "end")).alias("more"))
    nothing = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return based.join(more, "row", "left").select(
        "doc_id", "base", F.array_sort(F.filter(F.coalesce("more", nothing), lambda s: ~F.exists("base", lambda b: (
            b["start"] < s["end"]) & (s["start"] < b["end"])))).alias("added"))


def span_string(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in ALL_KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def _with_kind(kind: str):
    return lambda span: F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(kind).alias("kind"))


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with every base span and every discovered identifier replaced by its kind in angle brackets.

    Overlapping spans go together, under the first one's kind. Null and empty texts stay as they are, and so do all other
    columns, whatever their names; repeated rows stay repeated. Spans meet their texts by the texts' SHA-256.
    """
    rows = docs.select(F.col(text).alias("text"))
    key = F.unhex(F.sha2(F.col("text"), 256)).alias("key")
    found = staged(base_spans(rows).select(
        key, *[f"spans_{kind}" for kind in KINDS], "candidates"), "pii-spans")
    added = discover(found, rows, **options)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text).alias("text"))
    whole = whole.withColumn("key", key)
    spans = F.concat(*[F.transform(f"spans_{kind}", _with_kind(kind)) for kind in KINDS])
    marked = base_spans(whole).withColumn("spans", spans)
    if not added.isEmpty():
        more = found.select("key", F.explode("candidates").alias("c")).select("key", "c.*").join(
            small_side(added), "value").groupBy("key").agg(F.collect_set(F.struct("start", "end", "kind")).alias("more"))
        marked = marked.join(small_side(more), "key", "left").withColumn(
            "spans", F.concat("spans", F.coalesce("more", F.array().cast(
                "array<struct<start:bigint,end:bigint,kind:string>>"))))

    def replace(state, span):
        new = span["start"] >= state["pos"]
        parts = F.array(F.substring(F.col("text"), state["pos"].cast("int") + 1, (span["start"] - state["pos"]).cast("int")),
                        F.concat(F.lit("<"), span["kind"], F.lit(">")))
        return F.struct(F.greatest(state["pos"], span["end"]).alias("pos"),
                        F.when(new, F.concat(state["parts"], parts)).otherwise(state["parts"]).alias("parts"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate(F.array_sort("spans"), start, replace, lambda state: F.concat(
        F.array_join(state["parts"], ""), F.substring(F.col("text"), state["pos"].cast("int") + 1, 2147483647)))
    clean = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    return marked.withColumn("_clean", clean).select(*[
        (F.col("_clean") if c.lower() == text.lower() else F.col("_doc").getField(c)).alias(c) for c in docs.columns])
