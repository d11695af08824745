import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty and blank texts, copies, near copies, accents, control characters, and a text of 1.2 million characters."""
    long = prose("long", 180_000)
    base = prose(1, 400)
    words = base.split()
    near = " ".join([*words[:200], "changed", *words[201:]])
    own = [None, "", " \t\n", "Word", "word", "WORD", base, base, base.upper(), near, base + " and more", prose(2, 5), prose(3, 3), "ÄÖü ß é 漢字 \U0001f600 \x00 end", "a" * 3000, "a" * 1000 + "b" + "a" * 1000, prose(4, 300) + base[:300], long, long[:600_000] + "x" + long[600_001:]]
    return [(i * 3 % 19, t) for i, t in enumerate(own)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Rows with a null key, a row that comes twice, a key with two texts, and extra columns named like results."""
    rows = [(k, t, "s" + str(k % 3) if k % 4 else None, "x", 1.0) for k, t in texts]
    rows += [(None, "Word", "s1", "x", 1.0), (None, "nothing here", None, "x", None), rows[3], (rows[6][0], "another text under the same key", "s0", "x", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, label string, score double").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
