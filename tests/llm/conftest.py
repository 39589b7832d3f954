import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts; ids count up, and columns beside id and text have clashing names."""

    def make(texts, ids=None, **more):
        schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string, kept string"
        rows = [(i if ids is None else ids[i], t, (more.get("lang") or ["en"] * len(texts))[i], (more.get("source") or ["s"] * len(texts))[i], len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return make


ODD = ["", None, "  \n\t\n ", "one", "one", "a b c d e f g", "A b C d e F g", "é　ü x\x1cy\x85z", "line\n" * 40, "w " * 60_000, "x" * 300_000]


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, equal, very long."""
    return ODD
