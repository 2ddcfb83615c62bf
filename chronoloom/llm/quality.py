"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every rule is a ratio with a lowest and a highest allowed value. ``measures`` states the counts,
``RULES`` the table; ``judge`` compiles both into columns of the same scan. Nothing is shuffled and no
user function runs, so the work is one pass over the texts in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were with "
    "auf das dem den der des die ein eine für ich im ist mit nicht sich sie und von zu "
    "au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "al como con del el en es la las lo los no para por que se su un una y"
).split()

BLANKS = r" \t\n\x0B\f\r"  # of a word's end, as a character class
SYMBOLS = r"#*$%&|<>"
CAPITALS = r"A-Z"
WINDOW = 8  # words
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_capitals",
)


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie between ``low`` and ``high``; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


#: The threshold table. Counts are those of ``measures``.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.03, 1.0),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.4),
    Rule("capitals", "n_capitals", "word_chars", 0.0, 0.4),
)


def _count(text: Column, characters: str) -> Column:
    """How many code points of the text are in a character class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _repeated_words(hashes: Column) -> Column:
    """Words in windows found twice or more, given the hash of the window at each place.

    Places of windows are sorted by hash; those equal to a neighbour occur again. Their union is added up
    in order of place: each covers WINDOW words less those the one before it covered. Texts without a
    repeated window, nearly all, skip the sort.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(sorted_pairs: Column) -> Column:
        n = F.size(sorted_pairs)
        hash_at = lambda k: F.get(sorted_pairs, k)["h"]
        return F.transform(
            F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda k: ((k > 0) & (hash_at(k - 1) == hash_at(k))) | ((k < n - 1) & (hash_at(k + 1) == hash_at(k))),
            ),
            lambda k: F.get(sorted_pairs, k)["i"],
        )

    start = F.struct(F.lit(0).alias("covered"), F.lit(-WINDOW).alias("last"))

    def add(acc: Column, place: Column) -> Column:
        return F.struct(
            (acc["covered"] + F.least(F.lit(WINDOW), place - acc["last"])).alias("covered"), place.alias("last")
        )

    # transform over a one-element array binds the sorted pairs once
    places = F.get(F.transform(F.array(pairs), again), F.lit(0))
    return F.aggregate(F.sort_array(places), start, add, lambda acc: acc["covered"]).cast("long")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with one more, ``_m``: a struct of all counts of the whole text.

    Words are runs of characters other than blank, tab, newline, vertical tab, form feed and return. A
    null text has no words.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    out = docs.withColumn("_text", text)
    out = out.withColumn("_words", F.array_remove(F.split("_text", f"[{BLANKS}]+"), ""))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_windows", windows)
    lines = F.filter(F.split("_text", "\n"), lambda line: F.rlike(line, F.lit(f"[^{BLANKS}]")))
    out = out.withColumn("_lines", lines)
    out = out.withColumn(
        "_m",
        F.struct(
            n.cast("long").alias("n_words"),
            (F.length("_text") - _count(F.col("_text"), BLANKS)).cast("long").alias("word_chars"),
            _count(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long"))
            .otherwise(_repeated_words(F.col("_windows")))
            .alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            _count(F.col("_text"), CAPITALS).cast("long").alias("n_capitals"),
            # A filter on the counts must not be moved below this projection: it would compute each of
            # them, and the arrays they are made of, once per mention. Rows aren't numbered otherwise.
            F.monotonically_increasing_id().alias("_fence"),
        ),
    )
    return out.drop("_text", "_words", "_hashes", "_windows", "_lines")


def _passes(rule: Rule) -> Column:
    top, under = F.col(f"_m.{rule.numerator}"), F.col(f"_m.{rule.denominator}")
    # compared as products: no division, so both engines agree at the edges
    return (top >= rule.low * under) & (top <= rule.high * under)


def judge(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, and ``failed_rules`` by name.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in repeated windows. ``kept``: the
    base holds and every rule of the table passes. A null or empty text has no words and fails the base.
    Repeated rows are judged alike. Other columns aren't read.
    """
    narrow = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    return _verdict(measures(narrow), rules).select(
        "doc_id", *[F.col(f"_m.{c}") for c in COUNTS], "base_failed", "kept", F.concat_ws(",", "failed").alias("failed_rules")
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    given = docs.select(*[column(c).alias(a) for c, a in zip(docs.columns, names, strict=True)])
    judged = _verdict(measures(given, names[docs.columns.index(text_col)]), rules)
    return judged.where("kept").select(*[F.col(a).alias(c) for c, a in zip(docs.columns, names, strict=True)])


def _verdict(measured: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    failed = F.array_compact(F.array(*[F.when(~_passes(r), r.name) for r in rules]))
    base = (F.col("_m.n_words") < 20) | (100 * F.col("_m.n_repeat_words") > 30 * F.col("_m.n_words"))
    out = measured.withColumn("base_failed", base).withColumn("failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
