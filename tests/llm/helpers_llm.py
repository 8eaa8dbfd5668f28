"""Small document tables with every awkward row."""

import re

CLASHES = "band members label mark mark2 a b weight kept node component first_id length start sequence_id seed place"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))

AWKWARD = [
    (None, "no id but some words in this row here"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "One"),
    (6, "two words"),
    (7, LONG),
    (8, LONG + " end"),
    (9, "same row twice over and over again"),
    (9, "same row twice over and over again"),
    (10, "same row twice over and over again"),
    (11, "é" * 5000 + " 😀 " + "a" * 5000),
]


def docs(spark, rows, extra=True):
    """``doc_id, text`` with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES.split()]) if extra else df


def words(text):
    return WORD.findall((text or "").translate(LOWER))
