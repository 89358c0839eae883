"""Rows that try the operators: nulls, empties, long texts, ties, repeats and columns with clashing names."""

from __future__ import annotations

PHRASE = "the quick brown fox jumps over the lazy dog and runs far away from here"
MENU = "Home | About | Contact"
ODD = [
    (None, "a text without an id, of some ten words or more, to be sure"), (1, None), (2, ""), (3, " \t\n\n "), (4, PHRASE + "."),
    (5, PHRASE + "."), (5, PHRASE + "."), (6, PHRASE.upper() + "."), (7, "One short."), (8, "é🙂 ü " * 40 + "end."),
    (9, "word " * 3000), (10, "x" * 120_000), (11, "a@b" + ".c" * 30_000), (12, "1" + " 1" * 40_000), (13, ("y,'\"" * 5 + "\n") * 3000),
    (14, "a@b.c._x@y.z 1.2.3.4.5.6.7.8 x@y@z.com é🙂 +1 (555) 123-4567 4111 1111 1111 1111 and 999.1.1.1 4111-1111-1111-1112"),
    (15, " ".join(f"w{i}" for i in range(4000)) + "."), (16, "\x00 zero and   line   space \x85 next"),
    *[(100 + i, f"Shared Line\n  shared line \t\n\nown {i}\nSHARED LINE") for i in range(12)],
    *[(200 + i, f"{MENU}\n{PHRASE} number {i}.\n{MENU}") for i in range(11)],
]
SOURCES = [None, "", "a", "B", "é"]
# Names the operators use themselves, and names with dots and blanks.
CLASHES = ["size", "_text", "_block", "rank", "kind", "u.v", "a b", "_row", "_key", "start", "_n_lines", "_n_dropped", "_others", "_m1", "_time"]


def documents(spark, rows=None):
    rows = ODD if rows is None else rows
    data = [
        (i, text, "en", SOURCES[k % len(SOURCES)], len(text or ""), *[f"{c}{k}" for c in CLASHES]) for k, (i, text) in enumerate(rows)
    ]
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(data, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
