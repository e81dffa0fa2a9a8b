import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def document_rows(n: int = 120) -> list[tuple]:
    """Documents with nulls in every column, empty, tiny and long texts, exact and near copies, repeated rows."""
    rows = []
    for i in range(n):
        text = prose(i, 5 + (i * 37) % 200)
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
    long = prose(9999, 30_000)
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \t\n", "en", "s1", 3), (n + 3, "one", "en", "s2", 3), (n + 4, long, "en", "s0", len(long))]
    rows += [(n + 10 + i, rows[3][1], "en", "s0", None) for i in range(60)]  # a hot group of copies
    rows += [(n + 80 + i, rows[9][1].replace(" ", "  ") + " ", "en", "s3", None) for i in range(3)]  # equal but for white space
    rows += [(n + 90 + i, long + f" {i}", "de", "s4", None) for i in range(4)]  # near copies
    rows += [(n + 100, "naïve café Ärger 漢字 text with é", "fr", "s4", None), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="session")
def docs_rows():
    return document_rows()


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory, docs_rows):
    """A folder of tables: documents with columns that clash with names used inside, labels and pages."""
    d = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(docs_rows, SCHEMA)
    for c in ("row", "shard", "n", "size", "bits", "score", "_id", "_n", "h", "y", "kept", "doc", "file", "at", "copies", "_metadata", "id", "least"):
        from pyspark.sql import functions as F

        docs = docs.withColumn(c, F.lit("clash"))
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d)
