"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in that is was it for on with as be at by this are from or an than "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so "
    "de la le et les des en un du une que est pour qui dans par sur pas au avec ce il elle "
    "el y los se del las por con una su para al lo como más o pero sus le ha me"
).split()


class Rule(NamedTuple):
    """A text fails when the measure lies outside [low, high]; None leaves a side open."""

    measure: str
    low: float | None
    high: float | None


RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("dup_line_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.03, None),
)


def measures(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> DataFrame:
    """Every row of `docs` with the counts and ratios the rules speak of, as `__m`, a struct.

    A NULL or empty text has no words and all counts 0; its ratios are NULL.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.btrim(body, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANK}+"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        words.alias("__w"),
        lines.alias("__l"),
        (F.length(body) - F.regexp_count(body, F.lit(BLANK))).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
    )
    window = F.transform(
        F.sequence(F.lit(0), F.size("__w") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("__w"), i + k) for k in range(WINDOW)]),
    )
    row = row.select(
        "__row",
        F.size("__w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(list(stop_words)))).cast("long").alias("n_stop_words"),
        F.when(F.size("__w") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    # Only texts in which some window comes twice pay for sorting windows with their places.
    repeats = F.size("__h") > F.size(F.array_distinct("__h"))
    placed = F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    row = row.withColumn("__s", F.when(repeats, placed))
    # A window that has its like before or after it in the order occurs at least twice.
    like = lambda x, k: F.coalesce(F.get(F.col("__s"), k)["h"] == x["h"], F.lit(False))
    same = F.filter("__s", lambda x, i: like(x, i - 1) | like(x, i + 1))
    row = row.withColumn("__p", F.sort_array(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    return row.select("__row", *counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def ratio(name: str) -> Column:
    over = {
        "mean_word_chars": ("word_chars", "n_words"),
        "symbol_ratio": ("n_symbols", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "stop_word_ratio": ("n_stop_words", "n_words"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
    }
    top, bottom = over[name]
    # One stop word is given, so that a text of few words doesn't fail by chance.
    count = F.col(top) + (1 if name == "stop_word_ratio" else 0)
    return F.try_divide(count.cast("double"), F.col(bottom).cast("double"))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one condition."""
    parts = []
    for rule in rules:
        value = ratio(rule.measure)
        if rule.low is not None:
            parts.append(value >= rule.low)
        if rule.high is not None:
            parts.append(value <= rule.high)
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` in a struct `__row`, their counts, `base_failed` and `kept`.

    Row by row: repeated rows are judged alike, other columns may hold anything. NULL and empty
    texts fail the base rule.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = measures(docs, text).withColumn("base_failed", base)
    return found.withColumn("kept", ~F.col("base_failed") & passes(rules))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that pass, with the columns they came with."""
    # Not a filter: that would be pushed below the projections, with every measure written out anew.
    return judge(docs, text, rules).select(F.inline(F.when(F.col("kept"), F.array("__row"))))
