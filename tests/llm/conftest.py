import hashlib

import pytest

WORDS = ("the of and lead quote offer house river stone paper light green seven music garden winter silver "
         "market engine bridge signal harbour window basket candle mirror ladder pocket ribbon saddle").split()


def prose(seed: int, n: int) -> str:
    """Deterministic words, a sentence every eleven."""
    out = []
    for i in range(n):
        h = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append(WORDS[h % len(WORDS)] + (str(h % 97) if h % 3 == 0 else ""))
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(out))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with clashing extra columns from (doc_id, text) pairs, dealt over three partitions."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), "x", i) for i, t in rows]
        schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
                  "score string, node bigint")
        return spark.createDataFrame(full, schema).repartition(3) if full else spark.createDataFrame([], schema)

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "…–“"), (None, "no id at all here"), (6, "one")]


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and tiny texts, repeated rows, a null id, one long text."""
    return docs_of([*ODD, (7, prose(7, 30_000))])


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])
