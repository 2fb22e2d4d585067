import pytest


@pytest.fixture(scope="session")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark, rows, parts=3):
    """(doc_id, text, lang) as a documents table with a further column."""
    made = [(*r, None)[:3] if len(r) < 3 else r for r in rows]
    table = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in made], "doc_id long, text string, lang string, source string, n_chars long")
    return table.repartition(parts)


@pytest.fixture
def docs_of(spark):
    return lambda rows, parts=3: documents(spark, rows, parts)
