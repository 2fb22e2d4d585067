"""The registered queries: their columns, their oracles on the smallest tables, and tables with awkward further columns."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from tidemark.llm import ann, bpe, exact_dedup, langid, near_copies, packing, pii, registry, sharding, simhash, suffix_dedup, urls

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ann": "query_id rank vec_id score",
    "op2_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_sharding": "doc_id n_bytes depth shard",
    "op6_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op7_langid": "doc_id held_out lang_pred score",
    "op8_urls": "page_id host path rule verdict",
    "op9_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "pipeline": "doc_id piece start length ids ids_crc32 sequence_id offset",
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name, tmp_path):
    out = registry.QUERIES[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    out.write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    got = con.execute(f"SELECT count(*) FROM '{tmp_path}/out/*.parquet'").fetchone()[0]
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    whole = {"op8_urls": "pages", "op1_ann": None, "op4_packing": None, "pipeline": None}.get(name, "documents")
    if whole:
        assert got == con.execute(f"SELECT count(*) FROM {whole}").fetchone()[0]
    if name in registry.ORACLE_SQL:
        con.execute(f"CREATE TABLE expected AS {registry.ORACLE_SQL[name]}")
        names = ", ".join(f'"{c}"' for c in sorted(r[0] for r in con.execute("DESCRIBE expected").fetchall()))
        con.execute(f"CREATE TABLE got AS SELECT {names} FROM '{tmp_path}/out/*.parquet'")
        for a, b in (("got", "expected"), ("expected", "got")):
            assert con.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b}").fetchall() == []


#: Names that operators use inside.
INTERNAL = "row id hash fp key node chunk bin bucket root at cell task open pattern instance kind fits a b u v n size prefix slice slices place body lead points words host path rule verdict score leaf vector asks own best stays whole shard depth held word piece __id __key __text __added".split()
TEXTS = ["some words of one text that stand here twice", "some words of one text that stand here twice", "Some words of one text  that stand here twice", "write to a.b@example.com or 10.0.0.1", "4111 1111 1111 1111", "x " * 400, None, "", "é日本 " * 30, "another text " * 40, "another text " * 40 + "more"]


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i if i != 8 else None, t, "aa" if i % 2 else None) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "aa"), (1, TEXTS[1], "aa")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return plain, plain.select("*", *(F.lit(None if k % 3 else "x").cast("string").alias(c) for k, c in enumerate(INTERNAL)))


OPERATORS = {
    "bpe": lambda d, path: bpe.round_trip_digest(d, path),
    "simhash": lambda d, path: simhash.near_duplicates(d),
    "packing": lambda d, path: packing.pack(d, path, capacity=16).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "sharding": lambda d, path: sharding.assign(d, 500).select("doc_id", "n_bytes", "depth"),
    "exact_dedup": lambda d, path: exact_dedup.exact_groups(d).drop("kept"),
    "langid": lambda d, path: langid.predict(d, langid.train(d)),
    "pii": lambda d, path: pii.find(d),
    "suffix_dedup": lambda d, path: suffix_dedup.remove_repeats(d),
}
FILTERS = {
    "exact_dedup": exact_dedup.distinct_rows, "langid": lambda d: langid.accepted(d, langid.train(d)), "near_copies": near_copies.representatives,
    "simhash": simhash.representatives, "pii": pii.mask,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_further_columns_change_nothing(tables, vocabulary, name):
    plain, wide = tables
    assert rows_of(OPERATORS[name](wide, vocabulary)) == rows_of(OPERATORS[name](plain, vocabulary))


@pytest.mark.parametrize("name", list(FILTERS))
def test_filters_keep_further_columns(tables, name):
    plain, wide = tables
    out = FILTERS[name](wide)
    assert out.columns == wide.columns
    assert rows_of(out.select("doc_id", "text")) == rows_of(FILTERS[name](plain).select("doc_id", "text"))


def test_further_columns_of_vectors_and_pages(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    wide = vectors.select("*", *(F.lit("x").alias(c) for c in INTERNAL))
    assert rows_of(ann.search(wide, F.col("vec_id") % 20 == 0)) == rows_of(ann.search(vectors, F.col("vec_id") % 20 == 0))
    pages = spark.createDataFrame([(1, "http://gardennews.com/en/1", "<p>garden news"), (2, None, None), (3, "http://a.net/de/x", "<p>a")], "page_id long, url string, html string")
    wide = pages.select("*", *(F.lit("x").alias(c) for c in INTERNAL))
    assert rows_of(urls.judge(wide, registry.URL_RULES)) == rows_of(urls.judge(pages, registry.URL_RULES))


def test_very_long_texts(spark, vocabulary):
    """One text of some megabytes, without a space in one case."""
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long, "aa"), (2, "x" * 1_500_000, "bb"), (3, long, "aa"), (4, "short text", "bb")], "doc_id long, text string, lang string").repartition(2)
    assert {r["doc_id"]: r["group_size"] for r in exact_dedup.exact_groups(docs).collect()} == {1: 2, 2: 1, 3: 2, 4: 1}
    assert sorted(r["doc_id"] for r in near_copies.representatives(docs).collect()) == [1, 2, 4]
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 2_000_000, 4: 0}
    assert pii.find(docs).where("spans = ''").count() == 4 and langid.predict(docs, langid.train(docs)).count() == 4
    assert packing.pack(docs, vocabulary).where("doc_id = 1").agg(F.sum("length")).first()[0] == packing.pack(docs, vocabulary).where("doc_id = 3").agg(F.sum("length")).first()[0]
    assert sharding.assign(docs, 1 << 20).where("n_bytes > 1048576").select("shard").distinct().count() == 3
