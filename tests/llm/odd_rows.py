"""Nulls, empties, blanks, a very long text, ties and repeated rows."""

LONG = " ".join(f"word{k % 977}" for k in range(60_000))

ODD_ROWS = [
    (1, None), (2, ""), (3, "   \n\t"), (4, LONG), (5, "one"), (6, "one two"), (7, "Same text, here and there."), (8, "Same text, here and there."),
    (8, "Same text, here and there."), (None, "Same text, here and there."), (None, None), (9, "SAME text, here and there."), (10, "你好 世界 été ß"),
    (2, "other text under a known id"), (11, "...!!! 123"),
]
