"""What a question asks for: terms, synonyms, phrases, intent, mode and subject, as columns of built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import lexicon as L
from pagewright.functions.text import tokens, trimmed


def _any_of(words) -> Column:
    return F.exists("tokens", lambda t: t.isin(*words))


def _has_phrase(phrases) -> Column:
    return reduce(lambda a, b: a | b, (F.contains("normalised", F.lit(p)) for p in phrases))


def alternatives(terms: Column) -> Column:
    """Words near in meaning to any of the terms, without the terms themselves, in order."""
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in L.ALTERNATIVES.items() for x in pair))
    known = F.filter(terms, lambda t: t.isin(*L.ALTERNATIVES))
    return F.array_sort(F.array_except(F.flatten(F.transform(known, lambda t: table[t])), terms))


def intent() -> Column:
    out = F.lit("general")
    for name in reversed(L.INTENTS):
        out = F.when(_any_of(L.INTENTS[name]), name).otherwise(out)
    return out


def mode() -> Column:
    """explain, summary, find or answer; the first that fits."""
    explain = _any_of(L.EXPLAIN + L.ABOUT) | _has_phrase(L.ABOUT_PHRASES) | trimmed(F.col("normalised")).rlike(L.ABOUT_PATTERN)
    summary = _any_of(L.SUMMARY) | _has_phrase(L.SUMMARY_PHRASES)
    narrowed = F.exists("tokens", lambda t: ~t.isin(*L.STOPWORDS, *L.REQUEST, *L.VOCABULARY))
    listing = _any_of(L.ENUMERATION + L.PLURALS + L.MENTION) | _has_phrase(L.ENUMERATION_PHRASES) | _any_of(L.POINTING)
    return F.when(explain, "explain").when(summary, "summary").when(~narrowed & listing & F.col("intent").isin(*L.SHAPED, "general"), "find").otherwise("answer")


def analysis(questions: DataFrame) -> DataFrame:
    """``questions(qid, question)`` with terms, synonyms, phrases, intent, mode, content_terms, subject_terms, brief, subject,
    subject_is_delimited, names_only_document and reads_as_prose. A null question is an empty one."""
    text = F.coalesce("question", F.lit(""))
    normalised = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), L.CONTRACTIONS.items(), F.lower(text))
    phrases = F.filter(F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"'), 1), lambda p: F.lower(trimmed(p))), lambda p: p != "")
    q = questions.select("qid", text.alias("question"), normalised.alias("normalised"), phrases.alias("phrases"))
    q = q.withColumn("tokens", tokens(F.col("normalised")))
    plain = F.array_distinct(F.filter("tokens", lambda t: ~t.isin(*L.STOPWORDS)))
    q = q.withColumns({"terms": F.when((F.size(plain) == 0) & (F.size("phrases") == 0), F.array_distinct("tokens")).otherwise(plain), "intent": intent()})
    content = F.filter("terms", lambda t: ~t.isin(*L.REQUEST))
    tail = F.expr("substring(question, instr(question, ':') + 1)")
    delimited = F.contains("question", F.lit(":"))
    subject = F.when(delimited & (F.length(tail) > 0), trimmed(tail)).otherwise(trimmed(F.regexp_replace("question", L.java(r"(?i)^\s*(explain|clarify)\b[:\s]*"), "")))
    q = q.withColumn("mode", mode())
    return q.select(
        "qid", "question", "terms", alternatives(F.col("terms")).alias("synonyms"), "phrases", "intent", "mode",
        F.when(F.size(content) == 0, F.col("terms")).otherwise(content).alias("content_terms"),
        F.filter("terms", lambda t: ~t.isin(*L.REQUEST, *L.VOCABULARY)).alias("subject_terms"),
        ((F.col("mode") == "summary") & _any_of(L.BRIEF)).alias("brief"),
        F.when(F.col("mode") == "explain", subject).otherwise("").alias("subject"),
        ((F.col("mode") == "explain") & delimited).alias("subject_is_delimited"),
        (~F.exists("tokens", lambda t: ~t.isin(*L.WHOLE_DOCUMENT))).alias("names_only_document"),
        (F.size(F.split(trimmed(F.col("question")), r"\s+")) >= 8).alias("reads_as_prose"),
    )
