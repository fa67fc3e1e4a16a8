"""Rows that every operator has to take."""

#: Nulls, empty and blank texts, ties, repeats and a long one.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Same Text"), (5, "same text"), (6, "SAME TEXT"), (7, "same text "), (7, "same text "), (8, "é" * 50 + "\n" + "É" * 50), (9, "word " * 30_000), (None, "no id"), (10, "\u2028 odd \x1c marks \x0b here")]
