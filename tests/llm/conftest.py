import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with working names."""
    long_text = " ".join(f"word{i % 977} the of and" for i in range(20_000))
    rows = [
        (1, "the house of the man and the sea", "en"), (1, "the house of the man and the sea", "en"),
        (2, "the house of the  man and the sea", "en"), (3, None, "en"), (4, "", None), (5, " \n\t", "fr"),
        (None, None, None), (None, "der mann und das haus", "de"), (None, "der mann und das haus", "de"),
        (6, long_text, "en"), (7, long_text + "!", None), (8, "12345 -- ...", "en"), (9, "x", None),
    ]
    full = [(*r, "a", None, 1, "b", 2, None) for r in rows]
    return spark.createDataFrame(full, (
        "doc_id long, text string, lang string, __fp string, __key string, __dedup_sha int, kept string, shard int, score double"))
