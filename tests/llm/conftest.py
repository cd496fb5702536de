import pytest

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows(spark):
    """Real documents, odd ones, repeated rows and a null id."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return real + [(10_000 + k, t) for k, t in enumerate(brute.ODD_TEXTS)] + real[:3] + [(None, "null id")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, -1, "x", "x", 0) for i, t in rows], "doc_id long, text string, n_words int, items string, words string, salt int").repartition(5).cache()
