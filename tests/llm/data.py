"""Small tables with every awkward row, and helpers shared by the tests of the operators."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use within
        *[T.StructField(c, T.StringType()) for c in ("digest", "block", "shard", "_text", "_m", "kept", "score", "_kept", "_digest")],
    ]
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho the of and".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.8 else "") for _ in range(n))


def edge_texts() -> list[tuple]:
    base = prose(1, 60)
    rows = [
        (1, base),
        (2, base),  # a copy
        (3, base.replace(base.split()[30], "changed", 1)),  # a near copy
        (4, None),
        (5, ""),
        (6, "  \t\n "),
        (7, "one two"),
        (8, prose(2, 40_000)),  # very long
        (9, "Ünïcode ẞharp ΑΣ İstanbul 日本語 👍🏽 é a\u0085b c " + prose(3, 30)),
        (10, "x" * 20_000),  # one very long word
        (11, prose(4, 80)),
        (11, prose(4, 80)),  # a repeated row
        (None, prose(5, 50)),  # no id
        (None, None),
        (12, "same line here\nsame line here\n\nother line\n" * 6),
    ]
    return rows


def table(spark, rows, extra=True):
    junk = ("j",) * 9
    full = [(i, t, "en", None if i == 7 else f"s{(i or 0) % 3}", len(t or ""), *junk) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def edge(spark):
    return table(spark, edge_texts())


def empty(spark):
    return table(spark, [])
