"""Operators against brute force, and the cases every operator must survive."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from repoindex.llm import (
    bpe, decontaminate, language_id, pii_bootstrap, pu_quality, quality_llr, sharding, simhash_vp, token_shards,
    warc_fixity,
)
from repoindex.llm.components import connected
from repoindex.llm.text_stats import Block

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "a", "A b", "x" * 30_000, "é ß 日本 😀", "a@b.c_d@e.f 1.2.3.4", "same same", "same same"]


def docs_of(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, odd texts, and columns that have the names the operators add."""
    docs = docs_of(spark, ODD).union(docs_of(spark, ODD[-2:])).union(
        docs_of(spark, ["no id", "no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    return docs.withColumns({c: F.lit(1) for c in (
        "n_words", "SCORE", "spans_ip", "simhash", "slot", "token_ids", "kept", "n_hit", "hit_ranges", "item_ids", "key",
        "component_id", "recognised", "lang_pred", "_kept", "decoded", "base")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def model():
    return bpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


# ---- tokens ----

def test_bpe_is_the_library(model):
    rng = random.Random(1)
    alphabet = "ab'stmdrevl \n\t\r .!,12éß日 \xa0́<|>😀İ\x1c\x85　"
    texts = ["", "it's 'sabc ''s ?'s 'S", "a" * 300, " " * 200 + "y", "<|endoftext|>", "a<|endoftext|> b", "<|endof", "text|>"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(3000)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, bounds = model.encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[b:e].tolist() for b, e in zip(bounds[:-1], bounds[1:])] == want
    assert model.decode(ids, bounds).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]
    # Words remembered from an earlier block, and a memory that is full.
    again, _ = model.encode(pa.array(texts))
    assert (again == ids).all()


def test_bpe_blocks_are_small(spark, model):
    """A worker keeps most of what the arrays of a block took, so texts go to the model half a megabyte at a time."""
    class Sizes:
        """Stands for a model: the one id of a text is the number of bytes in its block."""

        def encode(self, texts):
            size = sum(len(t) for t in texts.to_pylist())
            return np.full(len(texts), size, np.int64), np.arange(len(texts) + 1)

        def decode(self, ids, bounds):
            return pa.array([str(len(ids))] * len(ids), pa.string())

    docs = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    rows = bpe.encode_and_decode(docs, Sizes()).collect()
    sizes = {int.from_bytes(r.token_ids, "little") for r in rows} | {int(r.decoded) * 10_000 for r in rows}
    assert len(rows) == 300 and max(sizes) <= 512 << 10
    sizes = {int.from_bytes(r.token_ids, "little") for r in bpe.encode_texts(docs, Sizes()).collect()}
    assert max(sizes) <= 512 << 10


def test_bpe_tables(odd, empty, model):
    rows = bpe.decode_tokens(bpe.encode_texts(odd, model), model).collect()
    assert len(rows) == odd.count() and all(r.decoded == (r.text or "") for r in rows)
    at_once = bpe.encode_and_decode(odd, model).collect()
    assert sorted(map(str, at_once)) == sorted(map(str, rows))
    assert bpe.decode_tokens(bpe.encode_texts(empty, model), model).count() == 0


def test_bad_bytes_decode_as_replacement(model):
    assert model.decode(model.byte_ids[np.array([0xC3, 0x41])], np.array([0, 2])).to_pylist() == ["�A"]


def test_token_shards_round_trip(spark, model, tmp_path):
    docs = docs_of(spark, ["word " * n for n in range(0, 60, 7)] + [None, "b" * 3000])
    rows = token_shards.materialise(docs, model, 5, 50256, str(tmp_path), length=16, per_shard=8, turns=3).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    files = {}
    for file in tmp_path.glob("shards/*/*/part-*"):
        shard = int(file.parent.name.removeprefix("shard="))
        assert shard not in files
        files[shard] = token_shards.read_records(file.read_bytes(), model, 16)
    assert sum(map(len, files.values())) == len(rows) and all(len(files[s]) == 8 for s in sorted(files)[:-1])
    for r in rows:
        ids, _ = model.encode(pa.array([texts[r.doc_id]], pa.string()))
        want = np.append(ids, 50256)[16 * r.sequence:16 * (r.sequence + 1)]
        shard, offset = token_shards.place_of(r.slot, model, 8, 16)
        record = files[shard][offset // token_shards.stride(model, 16)]
        assert (shard, offset) == (r.shard, r.offset) and len(want) == r.n_tokens
        assert record[:len(want)].tolist() == want.tolist() and set(record[len(want):].tolist()) <= {50256}
        assert zlib.crc32(record.tobytes()) == r.ids_crc32


def test_token_slots_do_not_depend_on_the_layout(spark, model, odd, tmp_path):
    """The same slots for rows in any order and partitioning, copies and null ids included, and others for another key."""
    docs = docs_of(spark, [f"word {n} " * (n % 40) for n in range(300)]).select("doc_id", "text").unionByName(
        odd.select("doc_id", "text"))

    def slots(rows, key=5):
        path = str(tmp_path / f"{len(list(tmp_path.iterdir()))}")
        found = token_shards.materialise(rows, model, key, 50256, path, length=16, per_shard=64, turns=2)
        return sorted(map(str, found.select("slot", "doc_id", "sequence", "ids_crc32").collect()))

    first = slots(docs)
    assert slots(docs.repartition(7).sortWithinPartitions(F.desc("doc_id"))) == first
    assert slots(docs.coalesce(1).orderBy(F.rand(3))) == first
    assert slots(docs, 6) != first


def test_broken_shards_go_on(spark, model, tmp_path, odd):
    """A broken write goes on without encoding or finished turns; odd rows, null ids and repeated rows are whole."""
    import shutil

    def run(**other):
        return sorted(map(str, token_shards.materialise(odd, model, other.pop("key", 5), 50256, str(tmp_path / "s"), 16,
                                                        per_shard=8, turns=3, **other).collect()))

    def stamps():
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / "s").glob("s*/**/part-*")}

    first, before = run(), stamps()
    row = token_shards.materialise(odd, model, 5, 50256, str(tmp_path / "s"), 16, per_shard=8, turns=3).first()
    assert len(list((tmp_path / "s" / row.folder).glob("part-*"))) == 1
    assert run() == first and stamps() == before
    turns = sorted((tmp_path / "s" / "shards").glob("turn=*"), key=lambda p: int(p.name[5:]))
    (turns[1] / "_SUCCESS").unlink()
    shutil.rmtree(next(turns[1].glob("shard=*")))
    assert run() == first
    after = stamps()
    assert {f for f in before if f"/{turns[1].name}/" not in f} == {f for f in before if after.get(f) == before[f]}
    assert len(after) == len(before)
    with pytest.raises(ValueError, match="another job"):
        run(key=6)


def test_token_shards_of_nothing(empty, model, tmp_path):
    assert token_shards.materialise(empty, model, 5, 50256, str(tmp_path)).count() == 0


# ---- sharding ----

@pytest.mark.parametrize("total", [1, 2, 3, 7, 10, 1000])
def test_permutation_is_a_bijection(spark, total):
    numbers = spark.range(total).withColumn("n", F.lit(total).cast("long"))
    places = [r.p for r in sharding.permute(numbers, "id", "n", 7, "p").orderBy("id").collect()]
    assert sorted(places) == list(range(total))
    other = [r.p for r in sharding.permute(numbers, "id", "n", 8, "p").orderBy("id").collect()]
    assert total < 10 or places != other


def test_shards_do_not_depend_on_the_layout(spark):
    docs = docs_of(spark, [f"text {i % 7}" for i in range(200)]).select("doc_id", "text")
    docs = docs.union(docs.limit(30))
    one = sorted(map(tuple, sharding.shard_rows(docs, 8, 3).collect()))
    two = sorted(map(tuple, sharding.shard_rows(docs.repartition(5).orderBy(F.desc("doc_id")), 8, 3).collect()))
    assert one == two and len(one) == 230
    sizes = {}
    for *_, shard, slot in one:
        sizes.setdefault(shard, []).append(slot)
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in sizes.values())


def test_many_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_PER_BLOCK", 10)
    rows = sharding.shard_rows(spark.range(100).select(F.lit("x").alias("text")), 4, 1).collect()
    assert sorted(r.row_number for r in rows) == list(range(100))


def test_shards_of_odd_rows(odd, empty):
    keys = sharding.document_keys(odd)
    rows = sharding.shard_rows(keys, 8, 3).collect()
    assert len(rows) == odd.count()
    assert sorted((r["size"], r.text_crc32) for r in rows) == sorted(
        (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert sharding.shard_rows(odd, 8, 3).count() == odd.count()
    assert sharding.shard_rows(sharding.document_keys(empty), 8, 3).count() == 0


# ---- near duplicates ----

def brute_fingerprint(text, size=3):
    words = space_words(ascii_lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + size]).encode(), seed=42)
              for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(5)
    texts = [*ODD[:5], "a b c d a b c d"] + ["".join(rng.choice("abÀ \n\t") for _ in range(rng.randrange(60)))
                                             for _ in range(200)]
    assert simhash_vp.fingerprints(pa.array(texts)).tolist() == [brute_fingerprint(t) for t in texts]


def brute_groups(values, bits=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("bands", [1, 2, 4, 5])
def test_trees_find_all_links(spark, bands, monkeypatch):
    monkeypatch.setattr(simhash_vp, "OUTRIGHT", 16)
    monkeypatch.setattr(simhash_vp, "SAMPLE_PER_LEAF", 16)
    rng = random.Random(bands)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        for _ in range(rng.randrange(8)):
            for _ in range(rng.randrange(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    found = {}
    for r in connected(simhash_vp.near_links(spark.createDataFrame([(v,) for v in signed], "simhash long"), bands=bands)
                       ).collect():
        found.setdefault(r.root, {r.root}).add(r.node)
    mask = (1 << 64) - 1
    assert {frozenset(v & mask for v in g) for g in found.values()} == brute_groups(sorted(values))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (3, 2)], "a long, b long")
    assert {(r.node, r.root) for r in connected(links).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}
    assert connected(links.limit(0)).count() == 0


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = simhash_vp.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    ids = {(r.doc_id, r.component_id) for r in rows}
    # Ids 0 and 1 are there twice, with no words and with "same same": two groups whose smallest id is 0.
    assert ids == {(0, 0), (1, 0), (2, 0), (8, 0), (9, 0), (None, None), *[(i, i) for i in range(3, 8)]}
    assert simhash_vp.near_duplicates(empty).count() == 0
    kept = simhash_vp.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [
        (False, i) for i in (0, 0, 3, 4, 5, 6, 7)] + [(True, None)]
    assert simhash_vp.keep_one(empty).count() == 0


# ---- decontamination ----

def brute_contamination(texts, items):
    def words(text):
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))

    windows = [(str(i) if i is not None else "", w[k:k + 10]) for i, t in items for w in [words(t)] if w
               for k in range(max(1, len(w) - 9))]
    out = []
    for text in texts:
        mine, hit, found = words(text), set(), set()
        for item, window in windows:
            for p in range(len(mine) - len(window) + 1):
                if mine[p:p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found.add(item)
        out.append((len(mine), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("pass_words", [10**6, 15])
def test_contamination(spark, pass_words):
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "cc", "dd1", "e"]
    items = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14]))))
             for i in range(12)] + [(None, "q r"), (3, None)]
    passages = [t.upper().replace("É", "é") for _, t in items if t is not None]
    texts = [*ODD, "Q-r"]
    for _ in range(100):
        noise = "".join(rng.choice(alphabet) + rng.choice([" ", ". ", "\n"]) for _ in range(rng.randrange(40)))
        texts.append(noise + rng.choice(passages))
    docs = docs_of(spark, texts).withColumn("N_HIT", F.lit("clash"))
    found = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"),
                                             pass_words=pass_words)
    rows = sorted(found.collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_hit, r.item_ids) for r in rows] == brute_contamination(texts, items)
    assert all(sum(r.hit_ranges[1::2]) - sum(r.hit_ranges[0::2]) == r.n_hit for r in rows)


def test_no_benchmark_and_no_documents(spark, odd, empty):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(odd, nothing).where("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(empty, nothing).columns == empty.columns


# ---- personal data ----

def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def brute_spans(text):
    rules = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
             (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(p) <= 255 for p in v.split("."))),
             (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 14 <= len(d) <= 19 and luhn(d)),
             (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 10 <= len(d) <= 15)]
    return sorted((m.start(), n, m.end()) for n, (rule, ok) in enumerate(rules) for m in re.finditer(rule, text or "")
                  if ok(m.group(), re.sub("[^0-9]", "", m.group())))


def test_base_spans(spark):
    rng = random.Random(1)
    alphabet = ["a", "b.", "@", "1", "22", "255", "300", ".", "-", " ", "+", "(", ")", "é", "😀", "\n", "4111111111111111",
                "4111 1111 1111 1111", "a@b.c", "_", "x@y", "%", "..", "1.2.3.4"]
    texts = [*ODD, "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "+1 (375) 555-4393", "a" * 5000 + "@", "x@" + "a." * 2000 + "b",
             "1.1.1.1 " * 1500]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(1500)]
    rows = pii_bootstrap.find_personal_data(docs_of(spark, texts)).collect()
    assert {r.doc_id: [tuple(s) for s in r.base] for r in rows} == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_contexts_discover_identifiers(spark):
    texts = [f"Hello world Kontakt: u{i}@x{i}.org today" for i in range(10)] + [
        "please Kontakt: hans12345(at)web now", "the year 20241 is", "again hans12345(at)web é.", None]
    docs = docs_of(spark, texts).withColumn("candidates", F.lit("clash"))
    added = {r.doc_id: [tuple(s) for s in r.added] for r in pii_bootstrap.find_personal_data(docs).collect()}
    assert {i: s for i, s in added.items() if s} == {10: [(16, 0, 32)], 12: [(6, 0, 22)]}
    clean = {r.doc_id: r for r in pii_bootstrap.redact(docs).collect()}
    assert clean[0].text == "Hello world Kontakt: <email> today" and clean[0].candidates == "clash"
    assert clean[10].text == "please Kontakt: <email> now" and clean[11].text == texts[11] and clean[13].text is None


def added_to(spark, texts):
    rows = pii_bootstrap.find_personal_data(docs_of(spark, texts)).collect()
    return {texts[r.doc_id][s.start:s.end]: pii_bootstrap.ALL_KINDS[s.kind] for r in rows for s in r.added}


def test_spaced_numbers_are_found_whole(spark):
    texts = [f"call Tel: +1 555 010 {1000 + i} now" for i in range(12)] + [
        "or Tel: 020 7946 0958 now.", "Tel: (212) 555-7713, at night", "in 2024 a b", "room 12 of 20", "Tel (030) 1234.",
        "her Tel:\nDE89 3704 0044 0532 0130 01 now"]
    assert added_to(spark, texts) == {"020 7946 0958": "phone", "212) 555-7713": "phone", "030) 1234": "phone",
                                      "DE89 3704 0044 0532 0130 01": "phone"}


def test_instances_induce_patterns_of_their_own(spark):
    texts = [f"x Kontakt: u{i}@x{i}.org" for i in range(10)]
    texts += [f"x Kontakt: id{i}00{i}7(at)web" for i in range(5)] + [f"y Ruf: id{i}00{i}7(at)web" for i in range(5)]
    texts += ["z Ruf: zz77777(at)web", "z rief zz99999(at)web", "nie 4444"]
    found = added_to(spark, texts)
    assert set(found) == {f"id{i}00{i}7(at)web" for i in range(5)} | {"zz77777(at)web"} and set(found.values()) == {"email"}


def test_keys_behind_a_sure_word_are_secrets(spark):
    rng = random.Random(6)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(8)]
    texts = [f'a b token = "{k}" c{n}' for n, k in enumerate(keys[:6])] + [f"commit {keys[6]} of many", "token = short7777",
             "the commit and commit and commit was"]
    assert added_to(spark, texts) == {**{k: "secret" for k in keys[:6]}, "short7777": "secret"}
    clean = pii_bootstrap.redact(docs_of(spark, texts)).collect()
    assert {r.text for r in clean if r.doc_id < 6} == {f'a b token = "<secret>" c{n}' for n in range(6)}


def test_graph_scores_against_brute_force(spark):
    rng = random.Random(12)
    names = [f"w{i}" for i in range(9)]
    seeds = {(rng.choice(["email", "phone"]), "before", rng.choice(names[:4]), f"s{i}"): rng.randrange(1, 4) for i in range(30)}
    edges = {(rng.choice(["before", "after"]), rng.choice(names), f"v{i % 25}"): rng.randrange(1, 3) for i in range(90)}
    words = {w: rng.randrange(15, 40) for w in names}
    scores, before = {}, None
    while True:
        patterns = {}
        for kind in ("email", "phone"):
            for side in ("before", "after"):
                for w in names:
                    own = [n for (k, s, x, _), n in seeds.items() if (k, s, x) == (kind, side, w)]
                    met = [(n, scores.get((v, kind), 0)) for (s, x, v), n in edges.items() if (s, x) == (side, w)]
                    conf = min((sum(own) + sum(n * c for n, c in met)) / (words[w] + 0.5), 0.999)
                    if len(own) + sum(c >= 0.8 for _, c in met) >= 3 and conf >= 0.5:
                        patterns[kind, side, w] = conf
        wrong = {}
        for (s, x, v), _ in edges.items():
            for kind in ("email", "phone"):
                if (kind, s, x) in patterns:
                    wrong[v, kind] = wrong.get((v, kind), 1) * (1 - patterns[kind, s, x])
        scores = {key: 1 - miss for key, miss in wrong.items()}
        now = (len(scores), sum(c >= 0.8 for c in scores.values()), sum(scores.values()))
        if before and now[:2] == before[:2] and now[2] - before[2] <= 0.005 * max(now[0], 1):
            break
        before = now
    found = pii_bootstrap.score_graph(
        spark.createDataFrame([(*k, n) for k, n in seeds.items()], "kind string, side string, word string, value string, n long"),
        spark.createDataFrame([(*k, n) for k, n in edges.items()], "side string, word string, value string, n long"),
        spark.createDataFrame(list(words.items()), "word string, word_n long"))
    got = {(r.value, r.kind): r.score for r in found.collect()}
    assert got.keys() == scores.keys() and scores
    assert all(abs(got[k] - scores[k]) < 1e-9 for k in got)


def test_personal_data_of_odd_rows(odd, empty):
    assert pii_bootstrap.find_personal_data(odd).count() == odd.count()
    assert pii_bootstrap.redact(odd).columns == odd.columns
    assert pii_bootstrap.find_personal_data(empty).count() == 0 and pii_bootstrap.redact(empty).count() == 0


# ---- quality ----

def brute_base(text):
    text = text or ""
    words = space_words(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if space_words(line)]
    return [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_base_counts():
    rng = random.Random(2)
    texts = [*ODD] + ["".join(rng.choice(["a", "b", " ", "\n", "é", "#", "|x ", "a b a\n"]) for _ in range(rng.randrange(80)))
                      for _ in range(300)]
    counts = quality_llr.base_counts(Block.of(pa.array(texts)))
    assert np.stack(counts, axis=1).tolist() == [brute_base(t) for t in texts]


def test_likelihood_ratio_tells_target_from_rest(spark, odd, empty):
    good = [" ".join(random.Random(i).choices(["the", "of", "and", "river", "house"], k=80)) for i in range(40)]
    bad = [" ".join(random.Random(i).choices(["!!X", "%%%", "ZZ$", "Q#Q"], k=80)) for i in range(40)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(50, 0), (None, 1), (3, None), (3, 1)],
                                   "doc_id long, quality int")
    rows = quality_llr.score_quality(docs, labels).collect()
    assert all(r.kept == (r.doc_id < 40 and not r.base_failed) for r in rows)
    assert {r.llr > 0 for r in rows if r.doc_id < 40} == {True}
    scored = quality_llr.score_quality(odd, labels.limit(0)).collect()
    assert len(scored) == odd.count() and {r.llr for r in scored} == {0.0}
    assert quality_llr.score_quality(empty, labels).count() == 0


def test_quality_does_not_move_with_copies(spark):
    common = "the of and river house under stone walks green evening".split()
    good = [" ".join(random.Random(i).choices(common, k=80)) for i in range(200)]
    poor = [" ".join(random.Random(i).choices([*common, "!!X", "%%%"], [1] * 10 + [2, 2], k=80)) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)], "doc_id long, quality int")
    hot = " ".join(random.Random(5).choices(["cheap", "pills", "here", "now"], k=80))
    for copies in ([], [hot] * 300, [good[0]] * 300):
        rows = quality_llr.score_quality(docs_of(spark, good + poor + copies), labels).where("doc_id < 260").collect()
        kept = {r.doc_id for r in rows if r.kept}
        assert kept == {r.doc_id for r in rows if r.doc_id < 200 and not r.base_failed} and len(kept) > 150


def test_all_trusted_labels_count(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert {r.llr for r in quality_llr.score_quality(docs_of(spark, texts), labels).collect()} == {0.0}
    assert not hasattr(quality_llr, "TRUSTED")


def test_ratios_and_threshold_by_brute_force(spark):
    """Scores, threshold and verdicts of every text against sums over its words and pairs, copies counted once."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words[:30] if i % 3 else words[10:], k=rng.randrange(1, 140))) for i in range(150)]
    texts += texts[:20] + ["", "one"]
    trusted = {i for i in range(0, 150, 2)} | {151}
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(1, 0)], "doc_id long, quality int")

    def buckets(text):
        return quality_llr.ngram_buckets(Block.of(pa.array([text], pa.string())))[0].tolist()

    trusted_texts = {texts[i] for i in trusted}
    raw, target = np.ones(quality_llr.BUCKETS), np.ones(quality_llr.BUCKETS)
    for text in set(texts):
        for bucket in buckets(text):
            raw[bucket] += 1
            target[bucket] += text in trusted_texts
    # Buckets are of words and neighbouring pairs: as many as 2 n - 1.
    assert all(len(buckets(t)) == max(2 * len(t.split()) - 1, 0) for t in texts)

    def score(text):
        terms = [np.log(target[b] / target.sum()) - np.log(raw[b] / raw.sum()) for b in buckets(text)]
        return sum(terms) / len(terms) if terms else 0.0

    rows = {r.doc_id: r for r in quality_llr.score_quality(docs_of(spark, texts), labels).collect()}
    assert all(abs(rows[i].llr - score(t)) < 1e-8 for i, t in enumerate(texts))
    steps = sorted(np.floor(rows[texts.index(t)].llr * quality_llr.STEPS) for t in trusted_texts
                   if not rows[texts.index(t)].base_failed)
    low, middle = steps[int(quality_llr.QUANTILE * len(steps))], steps[len(steps) // 2]
    limit = (2 * low - middle) / quality_llr.STEPS
    assert all(r.kept == (not r.base_failed and r.llr >= limit) for r in rows.values())
    assert {r.kept for r in rows.values()} == {True, False}


def test_positive_unlabelled(spark, odd, empty):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(300)]
    good = [". ".join(" ".join(rng.choices(words, k=rng.randrange(4, 20))).capitalize() for _ in range(rng.randrange(2, 12)))
            for _ in range(900)]
    bad = ["BUY!! NOW!! " * rng.randrange(10, 90) if i % 2 else " ".join(
        w + rng.choice(["###", "$$$"]) for w in rng.choices(words, k=rng.randrange(10, 90))) for i in range(300)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, 1) for i in range(400)] + [(None, 1), (5, 0)], "doc_id long, quality int")
    fitted = pu_quality.learn_quality(docs, labels)
    rows = pu_quality.score_documents(docs, fitted).where("doc_id >= 400").collect()
    right = sum(r.predicted == (r.doc_id < 900) for r in rows) / len(rows)
    assert right >= 0.95 and 0.6 < fitted.prior < 0.9
    scored = pu_quality.score_documents(odd, fitted).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    nothing = pu_quality.learn_quality(empty, labels)
    assert {r.score for r in pu_quality.score_documents(docs, nothing).collect()} == {0.5}


def test_risk_slopes_by_differences():
    """The slopes against finite differences of the risk as it is defined, on either side of zero."""
    rng = np.random.default_rng(3)

    def risk(z, prior):
        g = 1 / (1 + np.exp(-z))
        on_negatives = g[40:].mean() - prior * g[:40].mean()
        return prior * (1 - g[:40]).mean() + on_negatives if on_negatives >= 0 else -on_negatives

    for shift, negative in ((0.0, False), (-3.0, True)):
        z = rng.normal(0, 1, 80)
        z[40:] += shift
        got = pu_quality.pu_slopes(pu_quality.sigmoid(z), 0.6)
        g = pu_quality.sigmoid(z)
        assert (g[40:].mean() < 0.6 * g[:40].mean()) == negative
        for place in range(80):
            up, down = z.copy(), z.copy()
            up[place] += 1e-5
            down[place] -= 1e-5
            assert abs(got[place] - (risk(up, 0.6) - risk(down, 0.6)) / 2e-5) < 1e-8


def test_prior_by_brute_force():
    rng = np.random.default_rng(4)
    p, u = rng.normal(1, 1, 3000), np.concatenate([rng.normal(1, 1, 1200), rng.normal(-2, 1, 2800)])
    edges = [e for e in np.sort(p)[:int(0.7 * len(p))]]
    least = min(sum(u >= e) / len(u) / (sum(p >= e) / len(p)) for e in edges[::20])
    assert abs(pu_quality.estimate_prior(p, u) - least) < 0.02 and 0.28 < pu_quality.estimate_prior(p, u) < 0.35


def test_sampled_ids(spark):
    """The smallest hashes, whatever the layout; nulls and repeats add nothing, and few rows pass the bound."""
    ids = spark.range(5000).select(F.col("id").alias("doc_id")).union(spark.sql("SELECT CAST(NULL AS BIGINT)")).union(
        spark.sql("SELECT CAST(3 AS BIGINT) FROM range(4000)"))
    hashes = sorted((r.h, r.id) for r in spark.range(5000).select("id", F.xxhash64("id").alias("h")).collect())
    for layout in (ids, ids.repartition(7).orderBy(F.desc("doc_id"))):
        assert [r.doc_id for r in pu_quality.sample_ids(layout, 60).collect()] == [i for _, i in hashes[:60]]
    assert pu_quality.sample_ids(ids, 9000).count() == 5000 and pu_quality.sample_ids(ids.limit(0), 5).count() == 0


# ---- languages ----

def test_languages(spark, odd, empty):
    spoken = {"xx": "the of and river house under stone walks".split(), "yy": "el río casa bajo piedra que camina".split()}
    rows = [(i, " ".join(random.Random(i).choices(spoken[lang], k=20)), lang, None, None)
            for i, lang in enumerate(["xx", "yy"] * 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    fitted = language_id.fit_languages(docs.where("doc_id < 80").union(odd.select(*docs.columns)))
    found = language_id.predict_language(docs, fitted).where("doc_id >= 80").collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in found)
    strange = {r.text: r.lang_pred for r in language_id.predict_language(odd, fitted).collect()}
    assert strange[None] == strange[""] == strange[" \n\t"] == "und" and strange["a"] in spoken
    nothing = language_id.fit_languages(empty)
    assert {r.lang_pred for r in language_id.predict_language(odd, nothing).collect()} == {"und"}
    assert language_id.predict_language(empty, fitted).count() == 0


@pytest.mark.parametrize("languages", [2, 4, 12])
def test_texts_in_no_learned_language_are_not_recognised(spark, languages):
    rng = random.Random(languages)
    syllables = ["".join(pair) for pair in itertools.product("bcdfghklmnprstvz", "aeiouäöüéèñ")]
    spoken = []
    for _ in range(languages + 1):
        mine = rng.sample(syllables, 40)
        spoken.append(["".join(rng.choices(mine, k=rng.randrange(1, 4))) for _ in range(60)])

    def say(language, words):
        return " ".join(rng.choices(spoken[language], k=words))

    rows = [(say(n, rng.choice([4, 30, 200])), f"l{n}") for n in range(languages) for _ in range(2000 // languages)]
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=n)) for n in (60, 300, 3000) for _ in range(2)]
    foreign = [say(languages, n) for n in (30, 100, 1000)] + ["Русский язык один из восточнославянских языков", "日本語は日本の言語です"]
    clean = [say(n, k) for n in range(languages) for k in (1, 2, 3, 6, 50)]
    rows += [(text, f"l{i % languages}") for i, text in enumerate(noise + foreign)] + [(text, None) for text in clean]
    docs = docs_of(spark, [t for t, _ in rows]).drop("lang").join(
        spark.createDataFrame([(i, lang) for i, (_, lang) in enumerate(rows)], "doc_id long, lang string"), "doc_id")
    left = {r.text for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert not left & {*noise, *foreign} and left >= {*clean}
    # The scores of the model always add up to 1: they tell languages apart, not a language from none.
    fitted = language_id.fit_languages(docs)
    assert np.allclose(fitted.score(pa.array(noise)).sum(axis=1), 1, atol=1e-3)


def test_presence_rows_are_kernels():
    """Scores are those of the kernel between the text and the landmarks, by the definition over sets."""
    texts = pa.array(["the river", "el río", "the house under", "la casa"])
    sets = language_id.bucket_sets(texts)
    fitted = language_id.LanguageModel.fit(sets, ["a", "b", "a", "b"])
    kernel = np.array([[len(set(x) & set(y)) / np.sqrt(len(x) * len(y)) for y in sets] for x in sets])
    target = np.array([[1, 0], [0, 1]] * 2)
    values, vectors = np.linalg.eigh(kernel)
    space = kernel @ vectors / np.sqrt(values)
    centred = space - space.mean(axis=0)
    solution = np.linalg.solve(centred.T @ centred + language_id.RIDGE * 4 * np.eye(4), centred.T @ (target - 0.5))
    assert np.allclose(fitted.score(texts), centred @ solution + 0.5, atol=1e-4)


# ---- fixity ----

def test_audit_finds_the_damage(spark):
    rng = random.Random(4)
    one = [(f, r, 10 * r, 10 * r + 10, hashlib.md5(f"{f}{r}".encode()).hexdigest()) for f in range(3) for r in range(70)]
    two, want = [], set()
    for file, record, start, end, digest in one:
        turn = rng.randrange(20)
        if turn == 0:
            want.add((file, record, "missing"))
        elif turn == 1:
            want.add((file, record, "changed"))
            two.append((file, record, start, end, "bad" + digest))
        else:
            two.append((file, record, start, end, digest))
    two += [(1, 300, 0, 10, "x"), (9, 0, 0, 10, "y")]
    want |= {(1, 300, "extra"), (9, 0, "extra")}
    schema = "file long, record long, start long, end long, digest string"
    a, b = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    assert {(r.file, r.record, r.fault) for r in warc_fixity.audit(a, b).collect()} == want
    assert warc_fixity.audit(a, a.union(a.limit(5))).count() == 0
    assert warc_fixity.audit(a.limit(0), a.limit(0)).count() == 0 and warc_fixity.audit(a.limit(0), b).count() == len(two)


def test_audit_finds_moved_records(spark):
    schema = "file long, record long, start long, end long, digest string"
    one = [(f, r, 10 * r, 10 * r + 10, f"{f}-{r}") for f in range(3) for r in range(40 if f else 1)]
    # Padding before record 30 of file 1, a wrong index entry in file 2, and the only record of file 0 elsewhere.
    two = [(f, r, s + 4, e + 4, d) if (f, r) == (0, 0) or f == 1 and r >= 30 else (f, r, s, e + (f == 2 and r == 7), d)
           for f, r, s, e, d in one]
    found = warc_fixity.audit(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)).collect()
    assert {(r.file, r.record, r.start, r.end, r.digest, r.replica_digest, r.replica_start, r.replica_end) for r in found} == {
        (*a, a[4], b[2], b[3]) for a, b in zip(one, two) if a != b}
    assert {r.fault for r in found} == {"moved"} and len(found) == 12
    alone = warc_fixity.audit(*(spark.createDataFrame(side[:1], schema) for side in (one, two))).collect()
    assert [(r.fault, r.replica_start) for r in alone] == [("moved", 4)]


def test_manifest_is_gapless(spark):
    pages = spark.createDataFrame([(i % 20, f"u{i % 20}", "é" * (i % 20)) for i in range(60)] + [(None, None, None)],
                                  "page_id long, url string, html string")
    rows = warc_fixity.records(pages)
    placed = warc_fixity.manifest(rows, ["page_id", "length", "digest"], per_file=16).collect()
    contents = {hashlib.sha256(r.content.encode()).hexdigest(): r.content for r in rows.collect()}
    assert len(placed) == 61 and all(contents[r.digest].startswith("WARC/1.1\r\n") for r in placed)
    for file in range(4):
        mine = sorted((r for r in placed if r.file == file), key=lambda r: r.record)
        assert [r.record for r in mine] == list(range(16 if file < 3 else 13))
        assert [r.start for r in mine] == [0, *[r.end for r in mine][:-1]]
        assert all(r.end - r.start == len(contents[r.digest].encode()) for r in mine)


def test_every_stage_survives_clashing_names(spark, odd, tmp_path):
    spark.createDataFrame([(1, "b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    langs = odd.withColumn("lang", F.lit("en"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, langs, str(tmp_path))
        assert number == 4 or kept.columns == langs.columns
        assert 0 < kept.count() <= langs.count()
