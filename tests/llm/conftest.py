import pytest

EXTRA = ["score", "key", "cls", "n", "n_links", "class_id", "kept", "weight", "tokens", "size", "node", "i", "j", "component", "tkey", "seg", "pos", "line", "leaf", "topic", "probability", "label", "y", "item_id", "lang_pred", "held_out", "start"]


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (doc_id, text) rows, with columns whose names the operators use themselves."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, lang, source, len(t) if t is not None else None, *["x"] * len(EXTRA)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA))

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, odd characters."""
    long = " ".join(f"word{k % 977} of the long text {k}." for k in range(20_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f g h"), (4, "a b c d e f g h"), (None, "text without id"), (None, None), (5, long), (6, long + " end"), (7, "ünïcödé 日本語 🙂 <|endoftext|> \x00\x1f x"), (8, "one"), (9, "one"), (10, "1234 !!! ..."), (-5, "negative id here and more words")]
