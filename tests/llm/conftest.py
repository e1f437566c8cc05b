import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, token string, place string, label string, __sf_id int, __sf_hash string, __sf_digest string, __sf_place string, __sf_copies string, __sf_copy string, __sf_row string"
BASE = "the quick brown fox jumps over the lazy dog and runs away from all the hounds of the county before night falls again"


def rows():
    near = BASE.split() * 3
    other = near.copy()
    other[-1] = "tonight"
    long_text = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, "one  two"), (7, long_text), (8, BASE), (9, BASE), (9, BASE),
        (None, BASE), (None, None), (10, " ".join(near)), (11, " ".join(other)), (12, "ONE TWO"), (13, "Äpfel für Ömer " * 9), (14, "x"), (15, BASE.upper()),
    ]
    return [(i, t, "en" if (i or 0) % 2 else None, None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", None, *["clash"] * 4, 7, *["own"] * 6) for i, t in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
