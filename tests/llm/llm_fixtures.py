"""Odd inputs that every operator has to take."""

import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
PROSE = "the cat sat on the mat and looked at the dog while the rain fell on the roof of the old house by the sea"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): null and empty values, blanks, a very long text, ties, repeated rows, signs beyond ASCII."""
    texts = [PROSE, PROSE, PROSE + " again", None, "", " \n\t ", LONG, "Zoë said: naïve café 日本語 😀 it's 1,234.5%!\r\n\r\nÉ", "x", "a b", "\n\n", "don't 's 're"]
    return [*enumerate(texts), (0, PROSE), (0, PROSE), (None, PROSE + " null id"), (None, None), (None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with the columns of documents and extra ones whose names the operators use too."""
    extra = ["fingerprint", "score", "kept", "spans", "ids", "words", "mark", "key", "row", "n_words", "component_id", "code", "found_n_hit"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    data = [(i, t, None if k % 3 else "en", None, None if t is None else len(t), *["e"] * len(extra)) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory, odd_docs):
    """The odd documents beside small labels, benchmark and pages with nulls."""
    path = str(tmp_path_factory.mktemp("odd"))
    odd_docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, 1), (2, None, None), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog while the rain"), (2, None), (3, ""), (None, "x"), (1, "the cat sat on the mat and looked at the dog while the rain")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    urls = [(1, "http://a.example.org/en/5?q"), (2, None), (3, ""), (4, "no scheme"), (5, "https://X.COM/de/1#f"), (5, "https://X.COM/de/1#f"), (None, "ftp://b.net/" + "p" * 50_000), (7, "http://org"), (8, "http://y.com/fr/")]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory, odd_dir):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").filter("false").write.parquet(f"{path}/{name}.parquet")
    return path
