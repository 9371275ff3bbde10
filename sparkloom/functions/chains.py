"""Ordered reject rules for the common kinds of records.  Every limit, list and pattern is a parameter; the order is the result.

Each function gives a list of (reason, condition) for ``rules.first_reason`` or ``rules.all_reasons``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import extract as X
from . import text as T
from .rules import contains_any

Rules = list[tuple[str, Column]]


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _outside(n: Column, bounds: tuple[int, int]) -> Column:
    return (n < bounds[0]) | (n > bounds[1])


def code_rules(score: Column, statuses: Column, tests: Column, prompt: Column, code: Column, least_score: float, longest_prompt: int, longest_code: int, unsafe: list[str], style: str) -> Rules:
    """Reported score, reported test results, lengths, function style of the wording, a definition, unsafe marks."""
    good = F.size(statuses) > 0
    return [
        ("score", F.coalesce(score < least_score, F.lit(True))), ("reported_tests", ~F.coalesce(good, F.lit(False))),
        ("failed_tests", F.exists(statuses, lambda s: ~s.eqNullSafe(F.lit("pass"))) | (F.size(statuses) != F.size(tests))),
        ("prompt_length", F.length(prompt) > longest_prompt), ("code_length", F.length(code) > longest_code), ("style", ~F.coalesce(prompt.rlike(style), F.lit(False))),
        ("no_function", ~F.coalesce(code.rlike(r"(?m)^\s*def \w+"), F.lit(False))), ("unsafe", contains_any(code, unsafe)),
    ]


def instruction_rules(verified: Column, prompt: Column, answer: Column, tokens: Column, most_tokens: int, shut_out: dict[str, Column]) -> Rules:
    """Verified, not empty, within the budget, in none of the shut-out domains."""
    return [
        ("not_verified", ~F.coalesce(verified, F.lit(False))), ("empty", _blank(prompt) | _blank(answer)), ("budget", tokens > most_tokens), *shut_out.items(),
    ]


def exercise_rules(tests: Column, count: int, score: Column, code: Column, prompt: Column, banned: list[str], wording: list[str]) -> Rules:
    """An exact number of tests, a full score, no banned import or call, no wording about input and output."""
    call = "|".join(rf"\b{b}\b" for b in banned)
    return [
        ("test_count", F.coalesce(F.size(tests) != count, F.lit(True))), ("score", ~F.coalesce(score == 1.0, F.lit(False))), ("banned", code.rlike(call)),
        ("wording", contains_any(prompt, wording)),
    ]


def rewritten_rules(kind: Column, kinds: list[str], question: Column, longest_question: int, answer: Column, longest_answer: int) -> Rules:
    """Listed kind of rewriting, lengths, and an answer that ends in a number."""
    return [
        ("kind", ~F.coalesce(kind.isin(*kinds), F.lit(False))), ("question_length", F.length(question) > longest_question),
        ("no_number", X.number(answer)["value"].isNull()), ("answer_length", F.length(answer) > longest_answer),
    ]


def open_question_rules(question: Column, answer: Column, question_han: tuple[int, int], answer_han: tuple[int, int], tasks: Column, markers: list[str], category: Column) -> Rules:
    """Chinese characters of both sides within bounds, a task of the marked kinds, a known category."""
    return [
        ("question_length", _outside(T.han_count(F.coalesce(question, F.lit(""))), question_han)), ("answer_length", _outside(T.han_count(F.coalesce(answer, F.lit(""))), answer_han)),
        ("task", ~contains_any(F.coalesce(F.array_join(tasks, " "), F.lit("")), markers)), ("unmapped", category.isNull()),
    ]


def generated_choice_rules(reply: Column, stem: tuple[int, int], option: tuple[int, int], options: int = 4) -> Rules:
    """A generated question {question, options}: JSON shape, lengths, distinct options, no option inside the question."""
    q, o = X.json_field(reply, "$.question"), X.string_list(X.json_field(reply, "$.options"))
    return [
        ("json", q.isNull() | o.isNull()), ("options", F.size(o) != options), ("stem_length", _outside(F.length(q), stem)),
        ("option_length", F.exists(o, lambda x: _outside(F.length(F.trim(x)), option))), ("repeated", F.size(F.array_distinct(F.transform(o, T.squash))) < F.size(o)),
        ("leak", F.exists(o, lambda x: F.contains(T.squash(q), T.squash(x)))),
    ]


def translation_rules(label: Column, said: Column, text: Column, least_han: int, reason: Column, reason_length: tuple[int, int]) -> Rules:
    """The stated label, enough Chinese characters, a reason of sensible length."""
    return [
        ("label", ~F.coalesce(label == said, F.lit(False))), ("untranslated", T.han_count(F.coalesce(text, F.lit(""))) < least_han),
        ("reason_length", _outside(F.length(F.trim(F.coalesce(reason, F.lit("")))), reason_length)),
    ]


def rationale_rules(answer: Column, label: Column, length: tuple[int, int], empty_words: list[str]) -> Rules:
    """A strict last line, its letter the known one, no other letter stated before, a reason of sensible length that says something."""
    final, parts = X.strict_choice(answer), X.reason_and_letter(answer)
    stated = F.regexp_extract_all(F.upper(parts["reason"]), F.lit(r"(?:答案|选项?|ANSWER)\s*(?:是|为|IS)?\s*[:：]?\s*([A-D])"), F.lit(1))
    return [
        ("no_final", final.isNull()), ("label", ~F.coalesce(final == label, F.lit(False))), ("conflict", F.exists(stated, lambda x: x != label)),
        ("length", _outside(F.length(parts["reason"]), length)), ("says_nothing", contains_any(parts["reason"], empty_words)),
    ]


def disagreement(*fields: Column) -> Rules:
    """Labels that stand in several fields: one is missing, or two differ."""
    low = [F.upper(F.trim(f)) for f in fields]
    return [("missing", reduce(lambda a, b: a | b, [f.isNull() | (f == "") for f in low])), ("differs", F.size(F.array_distinct(F.array(*low))) > 1)]


# ---------------------------------------------------------------- budgets


def proxy_tokens(c: Column) -> Column:
    """Number of words, numbers and Chinese characters: a count that needs no vocabulary."""
    return F.size(T.word_tokens(F.coalesce(c, F.lit(""))))


def chat_length(messages: Column, count, per_message: int = 4, lead: int = 2) -> Column:
    """Tokens of a chat under a template with a fixed cost a message and at the start; ``count`` maps a text to its tokens."""
    return F.aggregate(messages, F.lit(lead).cast("long"), lambda n, m: n + count(m["content"]).cast("long") + F.lit(per_message))


def within_all(c: Column, counters: dict[str, tuple]) -> Column:
    """Whether a text keeps every tokenizer's budget; ``counters`` has (function of the text, limit) by name."""
    return reduce(lambda a, b: a & b, [count(c) <= limit for count, limit in counters.values()], F.lit(True))


def over_budget(c: Column, counters: dict[str, tuple]) -> Column:
    """Names of the tokenizers whose budget a text breaks."""
    return F.filter(F.array(*[F.when(count(c) > limit, F.lit(n)) for n, (count, limit) in counters.items()]), lambda x: x.isNotNull())


def budgeted(preferred: Column, other: Column, fits) -> Column:
    """The preferred answer if it fits, else the other one; an error if neither does."""
    neither = F.raise_error(F.lit("no answer keeps the token budget")).cast("string")
    return F.when(fits(preferred), preferred).when(fits(other), other).otherwise(neither)


def views(rules: dict[str, Column], name: str):
    """The filter of a named view; an unknown name raises."""
    if name not in rules:
        raise KeyError(f"no view {name}; there are {', '.join(sorted(rules))}")
    return rules[name]
