"""Rows with every oddity that the operators define a result for."""

#: Null id, null and empty text, white space only, a repeated row, an id with two texts, equal texts, one very long text.
ODD_ROWS = [
    (1, "One two  three four five six.", "en", "a"), (2, "One two three\tfour five six.", "en", "a"),
    (2, "One two three\tfour five six.", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "de", "b"),
    (None, "one of no id", "de", None), (None, "One two three four five six.", None, "c"), (6, "x", "en", "c"),
    (6, "another text of the same id", "en", "c"), (7, "é 12 ß " * 30_000, "de", "a"), (8, "-- 12 !!", "en", "a"),
]
