import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns of clashing names."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(1, "Hello there, my   friend.\n\nHow's it going?", "en", "s", 1, 5), (2, None, None, None, None, None), (3, "", "en", "s", 0, 1), (4, long, "fr", "s", 9, 2), (5, "  \t\n ", "de", None, 1, 3), (6, "日本語 é 😀 <|endoftext|> x", "es", "t", 3, 4), (6, "日本語 é 😀 <|endoftext|> x", "es", "t", 3, 4), (7, "12 34 !!", "en", "s", 8, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int").withColumns({c: F.lit(1) for c in ("rejected", "removed", "repeats", "id", "class", "key", "length", "row")}).repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
