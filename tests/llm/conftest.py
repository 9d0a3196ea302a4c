import pytest


@pytest.fixture(scope="session")
def awkward():
    """Rows (doc_id, text) with nulls, empty and long texts, ties, repeats and odd characters."""
    long_text = " ".join(f"word{i % 977} goes {i}." for i in range(30_000))
    copy = "A plain line that many documents share, long enough to count as one.\n"
    story = " ".join(f"tale{i} of the river and its {i % 13} bridges," for i in range(120)) + " the end."
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "two words"), (6, long_text), (7, story), (8, story),
        (9, story.replace("tale60", "saga60")), (10, copy * 3 + "own line"), (11, copy + "other"), (12, "x\n" + copy.upper()),
        (13, copy.strip()), (14, "  " + copy + "\n\n"), (15, copy), (16, "ÀÉ Σς ß ŉ İ 漢字 \U0001f600 é x"),
        (None, story), (None, "text without an id"), (18, "repeat"), (18, "repeat"), (18, "not the same"), (19, "<|endoftext|> it's 12.5%,"),
        (20, "a b c a b c a b c"), (-21, "negative"),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    """The same as a table, with columns whose names operators use inside."""
    extra = [(i, t, "en", "s", -1, "k", "d", 7, "fp", "r") for i, t in awkward]
    names = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string, dropped string,"
        " row bigint, fp string, rank string"
    )
    return spark.createDataFrame(extra, names)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
