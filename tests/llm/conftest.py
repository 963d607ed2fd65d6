import pytest

ODD = [
    (7, None), (3, ""), (None, "Alpha beta"), (9, "ALPHA beta"), (9, "ALPHA beta"), (4, "a"), (5, "é É ▁ \n\n  x\ty 中文 😀 "),
    (6, "tail space "), (8, " lead"), (11, "same text again. " * 400), (12, "same text again. " * 400), (13, "<|endoftext|> it's\x1cok"),
    (2, "q" * 20000), (14, "9" * 30000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, ties, repeated rows, empty and very long texts, and a clashing extra column."""
    rows = [(i, t, "en", "kept-by-user") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
