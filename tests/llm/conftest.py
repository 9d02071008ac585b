import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, n int, fp string, h string, host string, key int, tie string, evidence double, kept boolean, times int, start int, bid int"


def words(k, n=60):
    return " ".join(f"w{k}x{i * 7919 % 1000}" for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    passage = words(99, 70)
    texts = [
        (1, words(1)), (2, words(1)), (3, words(1).upper()), (4, words(4) + " " + passage), (5, passage + " " + words(5)), (6, ""), (7, None), (8, "   \n\t "), (9, "one"), (10, "two words"),
        (11, "a b c"), (12, words(12, 40000)), (13, words(13, 40000) + " " + passage), (14, "Ünï çödé \U0001f600 " * 30), (14, "Ünï çödé \U0001f600 " * 30), (14, "another text of the same id"), (None, words(1)), (None, None),
        (17, "x " * 200), (18, "#" * 50000), (19, "line\nline\n\nline\r\n other line\n" * 20), (20, "\x1c\x85\xa0 odd spaces  here   "), (-5, passage), (2**62, words(4) + " tail"), (21, words(1) + " end"),
    ]
    sources = ["b", "a", None, "", "ä", "a"]
    rows = [(i, t, "en" if k % 3 else None, sources[k % 6], None if t is None else len(t), k, k, "x", None, "y", k, "z", 0.5, True, k, k, k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
