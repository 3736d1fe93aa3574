"""The stemmer against its statement in SQL, word by word."""

import random

import duckdb
import pyarrow as pa

from repoindex.catalog.oracle import _stems
from repoindex.functions.stemmer import INVARIANT_AFTER_1A, IRREGULAR, STEP_2, STEP_3, STEP_4, STOP_WORDS, lexeme


def words():
    rng = random.Random(8)
    endings = [s for s, _ in STEP_2 + STEP_3] + STEP_4 + ["s", "es", "ies", "ied", "sses", "us", "ss", "ing", "ingly", "ed",
                                                         "edly", "eed", "eedly", "y", "e", "ll", "ying", "l"]
    starts = ["", "gener", "commun", "arsen", "y", "ay", "say", "hop", "hopp", "bab", "tr", "cont", "rel", "vil", "éc", "ski"]
    yield from [*STOP_WORDS, *IRREGULAR, *INVARIANT_AFTER_1A, "doc2vec", "日本", "çaisses", "sayyid", "yy", "y", "ß"]
    for start in starts:
        for ending in endings:
            yield start + ending
            yield start + rng.choice(endings) + ending
    for _ in range(20_000):
        yield "".join(rng.choice("aeiouybcdlnrstxzé") for _ in range(rng.randrange(1, 9))) + rng.choice(["", *endings])


def test_every_word_has_the_same_stem():
    table = pa.table({"word": sorted(set(words()))})
    con = duckdb.connect()
    con.register("vocabulary", table)
    found = dict(con.execute(_stems("SELECT word FROM vocabulary")).fetchall())
    want = {word: lexeme(word) for word in table["word"].to_pylist() if lexeme(word) is not None}
    assert len(want) > 15_000 and found == want
