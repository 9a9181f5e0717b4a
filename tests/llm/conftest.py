import random

import pytest

EDGE_DOCS = [  # null and empty texts, ties, repeated rows, null ids, one very long text
    (900, None), (901, ""), (902, " \t\n "), (903, "one two"), (904, "one two"), (905, "One TWO"),
    (906, "x " * 30_000), (907, "aéÉİ 中文 b."), (907, "another text with the same id"),
    (908, "twice the same row"), (908, "twice the same row"), (None, "no id here"), (None, None),
]


def corpus(seed: int = 5) -> list[tuple]:
    """(doc_id, text): random words with copies, edited copies, shared passages and benchmark passages."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 6 + [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, bench = say(60), say(25)
    rows = []
    for i in range(120):
        w = say(rng.randrange(3, 160))
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        if i % 7 == 0:
            w[1:1] = bench[rng.randrange(8) :]
        if i % 4 == 1 and rows:
            w = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows + [(1000, " ".join(bench))]


@pytest.fixture(scope="session")
def docs_rows():
    return corpus() + EDGE_DOCS


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    """The rows with extra columns whose names clash with what operators make."""
    rows = [(d, t, "en", f"src{i % 3}", i, "x", 1, None) for i, (d, t) in enumerate(docs_rows)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, shard int, _w string").cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, corpus()[-1][1], "z"), (2, "one two", "z"), (3, "", "z"), (4, None, "z"), (None, "w1 w2 w3", "z")], "item_id bigint, text string, words string")
