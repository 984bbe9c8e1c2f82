import pytest

#: Columns that a table may carry along, with names that operators use themselves.
CLASHING = {"n_words": "long", "score": "string", "size": "string", "kept": "string", "spans": "string", "text_hash": "string", "_row": "string", "_text": "string", "_draw": "string", "_source": "string", "_items": "string", "_hits": "string", "_found": "string", "_key": "string", "row": "string", "_id": "string", "_label": "string", "x": "string"}


@pytest.fixture
def texts(spark):
    """A table of documents from (doc_id, text), with further columns of clashing names."""

    def make(rows, extra=True):
        shape = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        if extra:
            shape += "".join(f", {c} {t}" for c, t in CLASHING.items())
            full = [(*r, 7, *"abcdefghijklmnopq"[: len(CLASHING) - 1]) for r in full]
        return spark.createDataFrame(full, shape)

    return make
