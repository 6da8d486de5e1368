import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, findings string, lang_pred string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text) as documents with further columns, two of which have the names of operators' results."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "s", None if t is None else len(t), "mine", "x") for i, t in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda n, seed: [random.Random(seed * 7919 + k).choice(vocabulary) for k in range(n)]


#: Null and empty texts, texts without words, one word, a very long text, repeated rows, a null id.
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d e f g " * 30_000), (6, "same words here again and again"), (6, "same words here again and again"), (7, "same words here again and again"), (None, "no id at all here"), (8, "été 日本 😀 ' s 'll"), (9, "x" * 200_000)]
