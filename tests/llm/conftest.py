import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, class long, h string, rank int, shard int, n long, component string, score double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed=1, words=WORDS):
    v, out = seed, []
    for _ in range(n):
        v = (v * 1103515245 + 12345) % 2**31
        out.append(words[v // 65536 % len(words)] + str(v // 131072 % 7))
    return " ".join(out)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, source), with extra columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "k", 5, "h", 1, 2, 3, "c", 0.5) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = prose(30_000, 9)
    return make([
        (1, "one two three four five six seven eight"), (2, None), (3, ""), (4, "   \n\t "), (5, long), (6, long + " tail"), (7, "One two three four FIVE six seven eight"), (7, "One two three four FIVE six seven eight"),
        (None, "one two three four five six seven eight"), (8, "é ñ 日本語 😀 \x00 a"), (9, "x" * 70_000), (10, "short", None), (11, "<|endoftext|> a  b\n\nc"), (12, "MIT License: released under the MIT License."),
    ])


@pytest.fixture(scope="session")
def empty(make):
    return make([])
