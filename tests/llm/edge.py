"""Rows that every operator must take."""

LONG = " ".join(f"word{i % 997}" for i in range(30_000))


def documents(spark, rows=None):
    """Nulls, empty and long texts, ties, repeated rows, a clashing id, and columns named as operators' own."""
    rows = rows if rows is not None else [
        (1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (None, "no id here at all"), (3, ""), (4, "   \n\t "),
        (5, LONG), (6, LONG), (7, "one"), (8, "Ünïcode İstanbul ẞ 中文 текст"), (1, "another text under the id one"), (9, "x\x00y"),
    ]
    extra = "id long, row int, key string, data string, rank int, bin int, start string, salt int, `a.b` string, spans int, sum string, score double, term string, n long"
    full = [(d, t, "en", "s", len(t or ""), 1, 2, "k", "d", 3, 4, "st", 5, "dot", 6, "su", 0.5, "te", 7) for d, t in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
