import pytest

from stratarates.llm import scratch


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    scratch.workers_find_package(spark)
    yield
    scratch.release()


@pytest.fixture
def documents(spark):
    """Rows that every operator must stand: nulls, empty and long texts, repeated rows, ties,
    and extra columns named like those that operators use."""
    words = "the quick brown fox jumps over a lazy dog while seven wizards mix potions near old mills"
    base = " ".join(f"{w}{i}" for i in range(12) for w in words.split())
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"),
        (3, base + " and a different end of text", "en", "b"),
        (4, None, "en", "a"), (5, "", None, None), (6, " \n\t ", "en", "a"), (7, "one", "en", "a"),
        (8, "One  ONE", "en", "b"), (None, base, "en", "a"), (None, None, None, None),
        (9, "x" * 5000 + " " + "y" * 200, "en", "a"), (10, "é ß 漢字 😀 mail me@ex.org +1 (443) 555-5793", "de", "b"),
        (11, " ".join(f"w{i % 997}" for i in range(20_000)), "en", "a"),
    ]
    rows = [(*r, 0, None if r[1] is None else len(r[1]), "extra") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h long, "
                                       "n_chars long, place string")


@pytest.fixture
def no_documents(documents):
    return documents.where("false")
