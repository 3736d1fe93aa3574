"""The splitter against its statement as recursive SQL, on texts that the given tables do not have."""

import random

import duckdb
import pyarrow as pa

from repoindex.catalog.oracle import oracle_sql
from repoindex.functions.splitter import split_text

PARTS = ["\nclass ", "\ndef ", "\n\tdef ", "\nfunction ", "\nconst ", "\nenum ", "\ntype ", "\n\n", "\n", "\n\n\n", " ", "  ",
         "x", "word", "é日😀", "\t", " ", "y" * 300, "long " * 100, "z" * 2500, "\nif ", "line\n" * 30]


def texts():
    rng = random.Random(4)
    for n in range(240):
        some = rng.sample(PARTS, rng.randrange(1, len(PARTS)))
        yield "".join(rng.choice(some) for _ in range(rng.choice([1, 5, 60, 400])))
    yield from ("", " \n", "a" * 2000, "a" * 2001, "a" * 9001, "\nclass " * 600, "\n" * 5000 + "b", "b" + " " * 5000 + "b")


def test_sql_states_the_same_chunks():
    rows = list(enumerate(texts()))
    # Numbers are dealt over the suffixes in blocks of twenty: spread the texts over all of them.
    table = pa.table({"doc_id": [20 * n for n, _ in rows], "text": [t for _, t in rows], "lang": ["en"] * len(rows),
                      "source": [f"src{n}" for n, _ in rows]})
    con = duckdb.connect()
    con.register("documents", table)
    got = con.execute(oracle_sql()["chunk_rows_all"]).fetchall()
    found = {(path, index): text for _, _, _, path, _, index, text in got}
    suffixes = [".py", ".ts", ".js", ".go", ".sql", ".md", ".txt", ".yml"]
    languages = {".py": "python", ".ts": "ts", ".js": "js"}
    want = {}
    for n, text in rows:
        if n % 10 < 8 and text.strip():
            suffix = suffixes[n % 10]
            rule = (4000, 400) if suffix in (".md", ".txt", ".yml") else (2000, 200)
            for index, chunk in enumerate(split_text(text, languages.get(suffix, "default"), *rule)):
                want[f"packages/src{n}/en/doc_{20 * n}{suffix}", index] = chunk
    assert len(want) > 500 and found == want
