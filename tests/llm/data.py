"""Small tables for the corpus operators: driver rows and hand-made edge cases."""

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, pos int, key string, site string"


def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    near = [f"alpha{i} beta gamma{i % 7}" for i in range(60)]
    rows = [
        (1, "one two three four five six seven eight", "en", "a"),
        (1, "one two three four five six seven eight", "en", "a"),
        (2, "ONE two three FOUR five six seven eight", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \n\t ", "en", "c"),
        (6, long, "en", "d"),
        (7, " ".join(near), "en", "a"),
        (8, " ".join(near[:-1]) + " changed", "en", "b"),
        (None, "a lonely text without an id", "en", "a"),
        (9, "tie", "en", "a"),
        (10, "tie", "en", "b"),
        (11, "x y éÉ \U0001f600 z\x1cq", "fr", "a"),
        (12, "double  space\n\n and <|endoftext|> here  ", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "c", 1, "k", "s") for r in rows], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
