import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest table, with odd rows added: nulls, empty, blank, short and very long texts, repeated rows and columns that clash with results."""
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(7)
    first = table.orderBy("doc_id").first()["text"]
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    near = list(base)
    near[150] = "changed"
    rows = [(10_001, None, None, None), (10_002, "", "en", "src1"), (10_003, " \n\t ", None, None), (10_004, "one two", "en", "src1"),
            (10_005, "x" * 60_000, None, "src2"), (10_006, " ".join(f"v{rng.randrange(10**6)}" for _ in range(20_000)), "en", "src1"),
            (10_007, " ".join(base), "en", None), (10_008, " ".join(near), "en", "src3"), (10_009, "ONE two", None, "src1"),
            (10_010, "a b " * 400, "en", "src1"), (10_011, first, "en", "src9"), (10_011, first, "en", "src9"), (None, "text of no one " * 9, "en", "src1"),
            (10_012, "日本語 テスト é 😀 " * 40, None, "src1"), (10_013, "own words " + " ".join(base[20:140]) + " other words", "en", "src4")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    both = table.unionByName(odd)
    for name in ("n_tokens", "spans", "bucket", "block", "k", "n", "id", "verdict", "host", "kept"):
        both = both.withColumn(name, F.lit("clash"))
    return both.repartition(5, "doc_id").persist()


@pytest.fixture(scope="session")
def rows(documents):
    """(doc_id, text, lang, source) of the rows."""
    return [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="session")
def distinct(rows):
    """(doc_id, text) of the rows that have an id, once each."""
    return sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: x[0])
