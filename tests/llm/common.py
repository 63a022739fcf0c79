"""Small tables with the awkward rows that every operator must bear."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, run string, size int, node string, __salt int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n: int, start: int = 0) -> str:
    return " ".join(f"w{(start + i) * 7919 % 10007}" for i in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing column names."""
    base = prose(60)
    texts = [
        (1, base), (2, base), (2, base), (3, ""), (4, None), (None, base), (None, None), (5, " \n\t "), (6, "one two"),
        (7, "ONE two"), (8, prose(4000, 100)), (9, prose(4000, 100) + " end"), (10, "x" * 30_000), (11, "12 34 !!"),
        (12, "日本語 テキスト \U0001f600 é"), (13, "a\n\na\n b "), (13, "other text of the same id"),
        (14, base.upper()), (15, prose(30, 40) + " " + prose(30, 5000)),
    ]
    return [
        (i, t, None if k % 5 == 0 else "en" if k % 2 else "de", None if k % 4 == 0 else "s1", "r", 1, None, 3)
        for k, (i, t) in enumerate(texts)
    ]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORDS.findall(text)
