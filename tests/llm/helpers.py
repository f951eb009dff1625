"""Small tables with the awkward cases that every operator must bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    """Rows with extra columns whose names clash with those the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, "s", None if t is None else len(t), 1, "x", 2) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS + ", score int, key string, row_id int")


AWKWARD = [None, "", " ", "\n\t", "a", "a b", "same text here again", "same text here again", "ünï çödé 日本 🙂", "x " * 30_000, "1" * 50_000, "word"]
