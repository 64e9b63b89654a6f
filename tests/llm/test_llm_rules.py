from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_cases import WORD, edge_texts, same_rows
from tickloom.llm import rules

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[p:p + 8]) for p in range(len(w) - 7))
    repeated = {p + k for p in range(len(w) - 7) if windows[tuple(w[p:p + 8])] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n, chars, symbols, dup = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = n < 20 or 100 * len(repeated) > 30 * n
    capitals = sum(c.isupper() for c in text)
    gone = symbols * 10 > n or chars < 2 * n or chars > 20 * n or dup * 10 > max(len(text.split("\n")), 1) * 3 or capitals * 2 > chars or text.count("!!") * 10 > n
    return n, chars, symbols, dup, len(repeated), failed, not failed and not gone


def test_against_brute_force(edge_docs):
    judged = rules.judge(edge_docs.select("doc_id", "text"))
    found = rules.measures(judged.select("row.doc_id", "row.text", F.col("rejected_by").isNull().alias("kept")))
    found = found.withColumn("base_failed", rules.base_failed(F.col("n_words"), F.col("n_repeat_words")))
    same_rows(found.select("doc_id", *COLUMNS).collect(), [(i, *brute(t)) for i, t, _ in edge_texts()])


def test_kept_documents_keep_their_columns(edge_docs, no_docs):
    kept = rules.good_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    same_rows([(r["doc_id"], r["text"]) for r in kept.collect()], [(i, t) for i, t, _ in edge_texts() if brute(t)[-1]])
    assert rules.good_documents(no_docs).count() == 0 and rules.judge(no_docs).count() == 0


def test_cascade_order_does_not_change_verdicts(edge_docs):
    all_ = rules.all_rules(F.col("text"), rules.words(F.col("text")))
    names = list(all_)
    one, two = (edge_docs.select("doc_id", "text", rules.cascade(all_, order).isNull().alias("stays")).collect() for order in (names, names[::-1]))
    same_rows(one, two)


def test_later_rules_are_not_computed_for_rejected_documents(spark, edge_docs):
    """A rule that fails when it is computed: no error where an earlier rule rejects, an error where none does."""
    docs = edge_docs.select("doc_id", "text")
    fails = F.raise_error(F.concat(F.lit("computed for "), F.substring(F.coalesce("text", F.lit("")), 1, 5))).cast("boolean")
    pair = {"short": F.coalesce(F.length("text"), F.lit(0)) < 10_000_000, "fails": fails}
    assert {r[0] for r in docs.select(rules.cascade(pair, ["short", "fails"])).collect()} == {"short"}
    with pytest.raises(Exception, match="computed for"):
        docs.select(rules.cascade(pair, ["fails", "short"])).collect()


def test_the_cascade_inside_the_operator_skips_rules(spark, monkeypatch, edge_docs):
    """The operator's own expression, with a second rule that fails when it is computed."""
    pair = lambda text, tokens: {"any": F.size(tokens) >= 0, "fails": F.raise_error(F.concat(F.lit("computed "), F.size(tokens))).cast("boolean")}
    monkeypatch.setattr(rules, "rank_rules", lambda *given: ["any", "fails"])
    assert {r[0] for r in rules.judge(edge_docs, pair).select("rejected_by").collect()} == {"any"}
    monkeypatch.setattr(rules, "rank_rules", lambda *given: ["fails", "any"])
    with pytest.raises(Exception, match="computed"):
        rules.judge(edge_docs, pair).select("rejected_by").collect()


def test_ranking_from_raw_text(spark):
    docs = spark.range(3000).select(F.concat(F.repeat(F.concat(F.lit("w"), F.col("id")), 3), F.repeat(F.lit(" some words here"), 300)).alias("text"))

    def mine(text, tokens):
        # alike in what they reject, unlike in what they cost
        return {"costly": rules.repeated_words(tokens) > 0, "cheap": F.length(text) > 0, "never": F.length(text) < 0}

    assert rules.rank_rules(docs, mine) == ["cheap", "costly", "never"]
    assert set(rules.rank_rules(docs)) == {"few_words", "repeated", "symbols", "word_length", "lines", "capitals", "shouting"}
