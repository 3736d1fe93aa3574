"""Filter audit, source divergence and winnowing against brute force, and the cases they must survive."""

import hashlib
import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repoindex.llm import filter_audit, source_divergence, winnowing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("part", "failed", "n", "good", "term", "p", "value", "range", "order", "owned", "hashes", "POSITIONS", "first")


def frame(spark, rows):
    """(doc_id, text, lang, source) as documents with columns of the names that the operators use themselves."""
    docs = spark.createDataFrame([(*row, None) for row in rows], SCHEMA)
    return docs.withColumns({c: F.lit("x") for c in CLASHES})


def prose(rng, words, size):
    return " ".join(rng.choice(words) for _ in range(size))


@pytest.fixture(scope="module")
def rows():
    """Copies, null and empty fields, repeated rows and ids, very long texts, ties."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "epsilonepsilon", "epsilonep", "epsiloneps", "zeta#", "ÉTÉ", "été", "x",
             "日本", "a1b2", "THE", "the", "internationalisation", "internationalisations"]
    many = [prose(rng, words, rng.choice([1, 3, 40, 250, 900])) for _ in range(40)]
    found = [(n, text, rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", None])) for n, text in enumerate(many)]
    found += [(100 + n, many[3], "en", "s1") for n in range(15)] + [(200 + n, None, "fr", "s2") for n in range(3)]
    found += [(300, "", "de", "s9"), (301, " \n\t", "de", "s9"), (302, "x" * 50_000, "en", "s4"),
              (303, prose(rng, words, 30_000), "en", "s4"), (7, many[3], "en", "s1"), (7, many[7], "en", "s1"),
              (7, many[7], "en", "s1"), (None, many[3], "en", "s1"), (None, "no id", "en", "s2"), (None, "no id", "en", "s2"),
              (304, "Only here", "es", "s1"), (305, "only HERE too", "es", "s1"), (306, "only here again", "es", "s1")]
    return found


# ---- filter audit ----

def failures(rows):
    smallest = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    for doc_id, text, _, source in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        yield doc_id, source or "", {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and smallest[text] < doc_id}


def brute_audit(rows, quality, toxic):
    parts = {}
    for doc_id, part, fails in failures(rows):
        parts.setdefault(part, []).append((doc_id, {f for f in fails if fails[f]}))
    out = set()
    for part, docs in parts.items():
        removed_by = Counter()
        found = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed_by[f] += len(gone)
                found.append((f, ("".join(order), step, len(left), len(gone), sum(f in d[1] for d in docs) - len(gone),
                                  sum(d[1] == {f} for d in docs), sum(d[0] in quality for d in gone),
                                  sum(d[0] in toxic for d in gone))))
        out |= {(part, *values, removed_by[f]) for f, values in found}
    return out


def test_audit_equals_every_order_applied(spark, rows):
    marks = [(0, 1, 0), (3, 1, 1), (3, 0, 0), (7, 1, None), (104, None, 1), (302, 1, 1), (9999, 1, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    found = filter_audit.audit_filters(frame(spark, rows), labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                             "toxic_lost", "shapley"]
    got = [tuple(r) for r in found.collect()]
    want = brute_audit(rows, {0, 3, 7, 302}, {3, 104, 302})
    assert len(got) == len(want) and set(got) == want


def test_shapley_solution_is_the_mean_over_orders():
    rng = random.Random(1)
    for players in (2, 3, 5):
        removed = [0] + [rng.randrange(1000) for _ in range((1 << players) - 1)]
        shares = [sum(a * b for a, b in zip(row, removed)) for row in filter_audit.shapley_solution(players)]
        orders = list(itertools.permutations(range(players)))
        for i in range(players):
            gains = 0
            for order in orders:
                before = sum(1 << j for j in order[:order.index(i)])
                gains += removed[before | 1 << i] - removed[before]
            assert shares[i] == Fraction(gains, len(orders))


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(frame(spark, []), labels).count() == 0
    some = filter_audit.audit_filters(frame(spark, [(1, None, None, None)]), labels).collect()
    assert len(some) == 600 and {r.part for r in some} == {""}


# ---- source divergence ----

def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_divergence(rows, top=200):
    docs = [(lang or "", source or "", terms_of(text)) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= 3]

        def counted(part):
            count = Counter(t for d in part for t in d[2])
            total = sum(count[t] for t in kept)
            return count, {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        _, usual = counted(own)
        sources = sorted({d[1] for d in own})
        shares = {s: counted([d for d in own if d[1] == s]) for s in sources}
        for s in sources:
            count, p = shares[s]
            pairs = [(sum((p[t] - q) ** 2 // q for t in kept for q in [shares[o][1][t]]), o) for o in sources if o != s]
            terms = [((p[t] - usual[t]) ** 2 // usual[t], t) for t in kept if count[t] and p[t] > usual[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out |= {(lang, s, part, item, value, n) for n, (value, item) in enumerate(ordered, 1)}
    return out


@pytest.mark.parametrize("block", [200_000, 3])
def test_divergence_equals_counting(spark, rows, block):
    found = source_divergence.source_divergence(frame(spark, rows), block_counts=block)
    got = [tuple(r) for r in found.collect()]
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows)


def test_divergence_in_slices_of_sources(spark, rows, monkeypatch):
    monkeypatch.setattr(source_divergence, "SOURCES_PER_TASK", 2)
    monkeypatch.setattr(source_divergence, "BLOCK_CELLS", 8)
    got = {tuple(r) for r in source_divergence.source_divergence(frame(spark, rows), top=2).collect()}
    assert got == brute_divergence(rows, 2)


def test_divergence_of_nothing(spark):
    assert source_divergence.source_divergence(frame(spark, [])).count() == 0
    rows = [(1, "one", "en", "a"), (2, None, "en", "b"), (3, "", None, None)]
    got = {tuple(r) for r in source_divergence.source_divergence(frame(spark, rows)).collect()}
    assert got == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_pointer_sort_equals_sorting_the_terms():
    rng = random.Random(3)
    for size in (1, 2, 500):
        words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(size)]
        words += rng.choices(words, k=size)
        flat = np.frombuffer(("\n".join(words) + "\n").encode(), np.uint8)
        starts, ends = source_divergence.word_bounds(flat, source_divergence.IS_TERM)
        order, new = source_divergence.sort_pointers(flat, starts, ends)
        assert list(order) == sorted(range(len(words)), key=lambda n: (words[n], n))
        in_order = sorted(words)
        assert list(new) == [n == 0 or in_order[n] != in_order[n - 1] for n in range(len(words))]


# ---- winnowing ----

def brute_winnow(text, gram, window):
    """(hash, position) by the definition, each gram hashed by itself."""
    points = [ord(c) for c in text or ""]
    if not points:
        return []
    grams = [points[n:n + gram] for n in range(max(len(points) - gram + 1, 1))]
    hashes = []
    for part in grams:
        value = 0
        for c in reversed(part):
            value = (value * pow(winnowing.BASE, -1, 1 << 64) + c + 1) % (1 << 64)
        value = (value * pow(winnowing.BASE, len(part) - 1, 1 << 64) + len(part)) % (1 << 64)
        for constant in winnowing.MIX:
            value = (value ^ value >> 33) * constant % (1 << 64)
        hashes.append(value ^ value >> 33)
    chosen = set()
    for n in range(max(len(hashes) - window + 1, 1)):
        part = hashes[n:n + window]
        chosen.add(n + max(i for i, h in enumerate(part) if h == min(part)))
    return [(hashes[n], n) for n in sorted(chosen)]


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_by_definition(spark, rows):
    short = [row for row in rows if len(row[1] or "") < 6000] + [(900 + n, "ab" * n, "en", "s") for n in (1, 2, 3, 4, 5, 40)]
    for gram, window in ((4, 5), (16, 64)):
        found = winnowing.fingerprints(frame(spark, short).select("doc_id", "text", "hashes", "POSITIONS"), "text", gram, window)
        assert found.columns == ["doc_id", "text", "hashes", "positions"]
        for r in found.distinct().collect():
            assert [(h % (1 << 64), p) for h, p in zip(r.hashes, r.positions)] == brute_winnow(r.text, gram, window)


def test_shared_passages_share_a_hash():
    rng = random.Random(9)
    gram, window = 5, 7

    def noise(size):
        return "".join(rng.choice("abcdé日😀") for _ in range(size))

    for _ in range(50):
        passage = noise(gram + window - 1)
        texts = [noise(rng.randrange(30)) + passage + noise(rng.randrange(30)) for _ in range(2)]
        points, bounds = winnowing.code_points(*winnowing.flat_text(pa.array(texts)))
        hashes, _, begins = winnowing.winnow(points, bounds, gram, window)
        assert set(hashes[:begins[1]].tolist()) & set(hashes[begins[1]:].tolist())


def brute_successors(rows, gram, window):
    key = {}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[4]))
    for n, (doc_id, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        own, new, other = (brute_winnow(t, gram, window) for t in (text, edited, after))

        def digits(part):
            return " ".join(f"{h:016x}" for h, _ in part)

        row = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(new),
               jaccard(own, new), jaccard(own, other))
        key[row] = key.get(row, 0) + 1
    return key


@pytest.mark.parametrize("ranges", [None, 1, 2, 23])
def test_successors_equal_brute_force(spark, rows, ranges):
    short = [row for row in rows if len(row[1] or "") < 3000]
    docs = frame(spark, short).repartition(5)
    texts = docs.select("text").distinct().withColumn("k", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    keys = {r.text: r.k for r in texts}
    found = winnowing.compare_successors(docs, gram=6, window=9, ranges=ranges)
    assert Counter(tuple(r) for r in found.collect()) == Counter(
        brute_successors([(*row, keys[row[1]]) for row in short], 6, 9))


def test_successors_of_few_and_none(spark):
    assert winnowing.compare_successors(frame(spark, [])).count() == 0
    one = winnowing.compare_successors(frame(spark, [(5, "abcdef", "en", "s")])).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(5, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    assert winnowing.compare_successors(frame(spark, [(None, None, None, None)] * 3)).count() == 3


def test_blocks_do_not_change_results(spark, rows, monkeypatch):
    docs = frame(spark, rows)
    whole = winnowing.compare_successors(docs).collect()
    monkeypatch.setattr(winnowing, "BLOCK_BYTES", 1000)
    assert Counter(map(tuple, whole)) == Counter(map(tuple, winnowing.compare_successors(docs).collect()))
