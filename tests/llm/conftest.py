import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="session")
def small_docs(table):
    return [(r.doc_id, r.text) for r in table("documents").collect()]


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, texts and columns, empty and long texts, ties, repeated rows, and columns with the operators' own names."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000)) + " jane@example.com"
    rows = [(1, "a b c d e f g", 1), (1, "a b c d e f g", 1), (None, "a b c d e f g", None), (2, None, 2), (3, "", 3), (4, " \t\n ", 4),
            (5, long, 5), (6, long, 6), (None, None, None), (7, "naïve ﷽ 😀 " * 30, 7)]
    names = "spans long, label string, node long, key long, bucket int, batch long, kind string, n long, row long, word string"
    return spark.createDataFrame([(i, t, n, None, n, n, None, n, None, n, n, "x") for i, t, n in rows],
                                 f"doc_id long, text string, {names}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -1")
