"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Rules are Boolean columns over the raw text and its words that say which
documents go; each computes the measures it needs itself. The words, which
nearly all rules need, are split once. On a bounded sample of raw texts each
rule is run alone: its rejection rate and its seconds above a run that only
splits words are its selectivity and cost. The cascade is one CASE expression
with the rules by falling rate per cost, so for a document that an early rule
rejects the later ones, and the measures in them, are not computed. The order
decides speed and the name of the rule only: a document stays when no rule
rejects it, in any order.

Repeated words are found inside the row, without a shuffle. Word hashes are
combined pairwise into hashes of 8 words; documents whose window hashes are all
distinct, nearly all, are done. Only for the others are windows sorted.

Defined cases: null and empty texts have no words, all counts are 0. A rule that
is null counts as not rejecting. No rows give no rows and the rules by name.
"""

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, count_of, let, packed, words
from tickloom.session import materialize

WINDOW = 8
SAMPLE_ROWS = 2000
RUNS = 3
Rules = Callable[[Column, Column], Mapping[str, Column]]


def window_hashes(tokens: Column) -> Column:
    """Hashes of all runs of 8 words: hashes of 1, 2, 4 and 8 words in turn."""

    def doubled(hashes: Column, step: int) -> Column:
        return let(hashes, lambda all_: F.transform(
            F.slice(all_, F.lit(1), F.greatest(F.size(all_) - step, F.lit(0))),
            lambda h, i: F.xxhash64(h, F.get(all_, i + step))))

    single = F.transform(tokens, lambda w: F.xxhash64(w))
    return doubled(doubled(doubled(single, 1), 2), 4)


def covered_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = let(marked, lambda m: F.filter(m, lambda x, k: (x["h"] == F.get(m, k - 1)["h"]) | (x["h"] == F.get(m, k + 1)["h"])))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    return let(places, lambda p: F.aggregate(
        F.transform(p, lambda at, k: F.least(F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda total, n: total + n))


def repeated_words(tokens: Column) -> Column:
    return let(window_hashes(tokens), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered_words(h)).otherwise(F.lit(0).cast("long")))


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def word_chars(tokens: Column) -> Column:
    return F.char_length(F.array_join(tokens, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return count_of(text, r"[#*$%&|<>]")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to ``docs``, for every row."""
    found = docs.withColumn("tokens", words(F.col(text)))
    return found.select(
        *docs.columns,
        F.size("tokens").cast("long").alias("n_words"),
        word_chars(F.col("tokens")).alias("word_chars"),
        symbol_count(F.col(text)).alias("n_symbols"),
        repeated_lines(F.col(text)).alias("n_dup_lines"),
        repeated_words(F.col("tokens")).alias("n_repeat_words"),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (n_repeat_words * 100 > n_words * 30)


def base_rules(text: Column, tokens: Column) -> dict[str, Column]:
    return {"few_words": F.size(tokens) < 20, "repeated": repeated_words(tokens) * 100 > F.size(tokens) * 30}


def more_rules(text: Column, tokens: Column) -> dict[str, Column]:
    """Rules beyond the base; each is a documented share of words, lines or characters."""
    n = F.size(tokens)
    lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n"))
    return {
        # a symbol in every tenth word
        "symbols": symbol_count(text) * 10 > n,
        # words of under 2 or over 20 characters on average
        "word_length": let(word_chars(tokens), lambda c: (c < n * 2) | (c > n * 20)),
        # three of ten lines repeated
        "lines": repeated_lines(text) * 10 > F.greatest(lines, F.lit(1)) * 3,
        # half of the characters capitals
        "capitals": count_of(text, r"\p{Lu}") * 2 > word_chars(tokens),
        # a tenth of the words ends in two exclamation marks
        "shouting": count_of(text, r"!!") * 10 > n,
    }


def all_rules(text: Column, tokens: Column) -> dict[str, Column]:
    return base_rules(text, tokens) | more_rules(text, tokens)


def rank_rules(docs: DataFrame, rules: Rules = all_rules, text: str = "text",
               sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> list[str]:
    """Rule names by falling rejection per second on raw texts of about ``sample_rows`` rows of all data.

    A rule's seconds are the least of ``RUNS`` runs above those of a run that
    only splits the words; a millisecond at least.
    """
    share = min(1.0, sample_rows / max(docs.select().count(), 1))
    sample = materialize(docs.select(F.col(text).alias("text")).sample(share, seed), "rule-sample")

    def seconds(column: Column) -> tuple[float, float]:
        found = sample.agg(F.avg(F.coalesce(column, F.lit(False)).cast("double")))
        took = []
        for _ in range(RUNS):
            started = time.perf_counter()
            rate = found.first()[0]
            took.append(time.perf_counter() - started)
        return min(took), rate or 0.0

    split = words(F.col("text"))
    idle = seconds(let(split, lambda tokens: F.size(tokens) < 0))[0]
    alone = lambda name: let(split, lambda tokens: rules(F.col("text"), tokens)[name])
    score = {}
    for name in sorted(rules(F.col("text"), split)):
        took, rate = seconds(alone(name))
        score[name] = rate / max(took - idle, 1e-3)
    return sorted(score, key=lambda name: -score[name])


def cascade(rules: Mapping[str, Column], order: list[str]) -> Column:
    """The name of the first rule in ``order`` that rejects; null for documents that stay."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(rules[name], F.lit(name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules: Rules = all_rules, text: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row of ``docs`` as ``row``, with ``rejected_by``: a rule that rejects it, null for documents that stay."""
    order = rank_rules(docs, rules, text, sample_rows)
    value = F.col(f"row.`{text}`")
    return packed(docs).withColumn("rejected_by", let(words(value), lambda tokens: cascade(rules(value, tokens), order)))


def good_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    return judge(docs, **options).where(F.col("rejected_by").isNull()).select("row.*")
