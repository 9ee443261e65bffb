"""Quality rules: a threshold table compiled into one projection, without user functions.

``RULES`` is the table: a metric, and the least and greatest value a kept document may have. Adding a rule is adding
a row. ``measured`` computes all metrics of a text in one projection; ``verdict`` turns the table into one condition.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from risklane.llm.common import WORD, let, spare_name, words_of


class Rule(NamedTuple):
    name: str
    metric: str
    least: float | None
    most: float | None


# The threshold table. Ratios of a text without words are null, and a null passes no rule.
RULES = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.05),
    Rule("shouting", "mark_ratio", None, 0.05),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
)
# Fixed value: frequent function words of the languages in the corpus; any of them counts, whatever the language.
STOP_WORDS = {
    "en": "the of and to in is that for it was on are as with be at by this from or an",
    "de": "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an",
    "fr": "de la le et les des en un une du dans est que qui pour sur au par pas avec",
    "es": "de la que el en y a los del se las por un para con no una su al lo",
}
SYMBOLS = "#*$%&|<>"
MARKS = "!?~^=_"


def stop_forms() -> list[str]:
    """Stop words as they stand in a text, bare and before a mark."""
    words = sorted({word for words in STOP_WORDS.values() for word in words.split()})
    return [word + mark for word in words for mark in ("", ".", ",", ";", ":")]


def count_of(text: Column, characters: str) -> Column:
    """How many of a few characters a text has: what is left of it without the runs of all others."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that stand in the text twice or more.

    Texts whose windows all have different hashes have none; that is known without sorting. In the others, windows
    are sorted with their positions, so equal ones are neighbours; the positions found are sorted and each adds
    the words that the one before it does not cover. The cost is n log n, and memory a few copies of the text.
    """
    def heads(all_words: Column) -> Column:
        return F.slice(all_words, F.lit(1), F.greatest(F.size(all_words) - 2, F.lit(0)))

    def hash_at(word: Column, at: Column, all_words: Column) -> Column:
        return F.xxhash64(word, F.get(all_words, at + 1), F.get(all_words, at + 2))

    def all_differ(all_words: Column) -> Column:
        hashes = F.transform(heads(all_words), lambda word, at: hash_at(word, at, all_words))
        return let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))

    def window_at(word: Column, at: Column, all_words: Column) -> Column:
        return F.struct(F.concat_ws(" ", word, F.get(all_words, at + 1), F.get(all_words, at + 2)).alias("w"),
                        at.alias("i"))

    def repeated(windows: Column) -> Column:
        def again(window: Column, at: Column) -> Column:
            return (F.coalesce(window["w"] == F.get(windows, at - 1)["w"], F.lit(False))
                    | F.coalesce(window["w"] == F.get(windows, at + 1)["w"], F.lit(False)))
        return F.sort_array(F.transform(F.filter(windows, again), lambda window: window["i"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda start, at: F.least(
            F.lit(3), F.coalesce(start - F.get(starts, at - 1), F.lit(3))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def windows_of(all_words: Column) -> Column:
        return F.sort_array(F.transform(heads(all_words), lambda word, at: window_at(word, at, all_words)))

    exact = let(windows_of(words), lambda windows: let(repeated(windows), covered))
    return F.when(all_differ(words), F.lit(0).cast("long")).otherwise(exact)


def line_counts(text: Column) -> Column:
    """struct(lines with a word, those equal to an earlier line)."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return let(lines, lambda found: F.struct(
        F.size(found).cast("long").alias("lines"),
        (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("dups")))


def measured(df: DataFrame, text_col: str = "text", name: str = "_q") -> DataFrame:
    """All columns of ``df`` and a struct of the counts of its text, in one projection."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(words: Column) -> Column:
        n_words = F.size(words).cast("long")
        word_chars = F.length(F.array_join(words, "")).cast("long")
        stops = F.filter(words, lambda word: F.lower(word).isin(stop_forms()))
        return F.struct(
            n_words.alias("n_words"), word_chars.alias("word_chars"),
            count_of(text, SYMBOLS).alias("n_symbols"), count_of(text, MARKS.replace("^", r"\^")).alias("n_marks"),
            F.size(stops).cast("long").alias("n_stop"),
            line_counts(text).alias("lines"),
            repeat_words(words).alias("n_repeat_words"))

    return df.withColumn(name, let(words_of(text), counts))


def metrics(counts: Column) -> dict[str, Column]:
    """The columns that rules may name."""
    words = F.nullif(counts["n_words"], F.lit(0)).cast("double")
    chars = F.nullif(counts["word_chars"], F.lit(0)).cast("double")
    lines = F.nullif(counts["lines"]["lines"], F.lit(0)).cast("double")
    return {
        "n_words": counts["n_words"], "mean_word_chars": counts["word_chars"] / words,
        "symbol_ratio": counts["n_symbols"] / chars, "mark_ratio": counts["n_marks"] / chars,
        "stop_ratio": counts["n_stop"] / words, "dup_line_ratio": counts["lines"]["dups"] / lines,
    }


def passes(rule: Rule, value: Column) -> Column:
    inside = F.lit(True)
    if rule.least is not None:
        inside &= value >= F.lit(rule.least)
    if rule.most is not None:
        inside &= value <= F.lit(rule.most)
    return F.coalesce(inside, F.lit(False))


def decided(counts: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(base check failed, all rules met): the whole table as two conditions."""
    ratio = metrics(counts)
    base_failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    return base_failed, reduce(lambda a, b: a & b, [passes(rule, ratio[rule.metric]) for rule in rules], F.lit(True))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ratios and verdict per row, one row for each of ``df``.

    A null text counts as empty: no words, so the base check and every ratio rule fail. Repeated rows are judged
    alike; columns of ``df`` beside the id and the text are ignored. ``failed`` names the rules not met, in order.
    """
    picked = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = F.col("_q")
    found = measured(picked).select("doc_id", "_q")
    ratio = metrics(counts)
    met = {rule.name: passes(rule, ratio[rule.metric]) for rule in rules}
    base_failed, verdict = decided(counts, rules)
    return found.select(
        "doc_id", counts["n_words"].alias("n_words"), counts["word_chars"].alias("word_chars"),
        counts["n_symbols"].alias("n_symbols"), counts["lines"]["dups"].alias("n_dup_lines"),
        counts["n_repeat_words"].alias("n_repeat_words"), base_failed.alias("base_failed"),
        (~base_failed & verdict).alias("kept"),
        *[F.round(value, 6).alias(name) for name, value in ratio.items() if name != "n_words"],
        F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in met.items()]).alias("failed"))


def kept_rows(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df``, whole, that pass the base check and all rules."""
    name = spare_name(df, "_q")
    failed, verdict = decided(F.col(name), rules)
    return measured(df, text_col, name).filter(~failed & verdict).select(*df.columns)
