"""Small tables with every awkward row: nulls, blanks, copies, long texts, repeated rows."""

import random

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def documents(spark, rows):
    """doc_id and text, with further columns whose names could clash with those of the operators."""
    full = [(i, t, "en", f"s{(i or 0) % 3}" if i != 4 else None, len(t or ""), 7, "k", 1) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, component long, key string, kept int")


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (5, LONG), (6, "\x00\x1c é ß 漢字 \U0001f600"), (None, "no id at all"), (7, "one")]
