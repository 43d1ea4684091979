import pytest


@pytest.fixture(scope="session")
def model():
    from pacelane.llm.queries import piece_model

    return piece_model()


@pytest.fixture
def docs(spark):
    """Frame of documents from (doc_id, text) rows, with columns whose names operators use for their own."""

    def build(rows, **more):
        data = [(i, t, more.get("lang"), None, None, "x", 1.0) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, spans string, score double")

    return build
