import pytest

#: Nulls, empty, blank and wordless texts, repeated ids and rows, copies, non-Latin scripts.
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(3000))
PASSAGE = "this passage of well over a hundred bytes is shared by several documents and must only stay in the first of them, always"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 5),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "one"),
    (6, "one two"),
    (7, "The quick brown fox jumps over the lazy dog. " * 5),
    (7, "another text under an id that is taken already"),
    (8, "Ünïcödé – naïve café, 東京 の祭り 🎉🎉 " + PASSAGE),
    (9, PASSAGE + " and then it goes on in its own way"),
    (10, "before it " + PASSAGE),
    (10, "before it " + PASSAGE),
    (None, "no id here, but " + PASSAGE),
    (None, None),
    (11, LONG),
    (12, LONG + " end"),
    (13, "a" * 5000),
    (14, "\x1c\x1d mixed \x85 spaces　here \x00 nul"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Extra columns carry names that operators use inside."""
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), k, k, k, k) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, _part int, row int, fp long, h int"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
