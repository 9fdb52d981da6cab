"""Rows that operators must take: nulls, repeats, empty and long texts, one id for two texts."""

LONG = "long " * 40_000
ODD_ROWS = [(1, None, "a"), (2, "", None), (3, "x", "a"), (3, "x", "a"), (4, "same words here and there again", "b"), (5, "same words here and there again", "b"), (None, "no id has this text at all", "c"), (6, LONG, "a"), (7, "été \u00a0 ünï \U0001f600 ok", "b"), (3, "another text under one id", "a")]
