import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names clash with results."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 1, "x", "y", 5.0, "z") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, shard int, fingerprint string, component_id string, target double, owner string")

    return make


ODD = [(None, "a null id"), (1, None), (2, ""), (3, "same Text"), (4, "SAME text"), (4, "SAME text"), (5, "ÀÉ \x0b odd space"), (6, "word " * 30_000), (7, "x" * 200_000), (None, None)]


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    return docs_of(ODD)
