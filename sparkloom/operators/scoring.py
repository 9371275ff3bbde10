"""Scores of responses by domain, and answers that are kept only when verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import extract as X
from ..functions import text as T


def number_score(response: Column, reference: Column, strict: bool = False) -> Column:
    """struct(correct, canonical): the response's number against the reference's."""
    known = X.number(reference)["value"]
    return X.named(
        X.number(response, strict),
        lambda said: F.struct(F.coalesce(said["value"] == known, F.lit(False)).alias("correct"), F.coalesce(said["canonical"], F.lit(False)).alias("canonical")),
    )


def choice_score(response: Column, letter: Column, variant: str = "explicit") -> Column:
    """struct(correct, canonical): the response's letter against the known one; canonical when a strict last line has it."""
    said = X.choice(response, variant)
    return F.struct(F.coalesce(said == X.choice_letter(letter), F.lit(False)).alias("correct"), X.strict_choice(response).isNotNull().alias("canonical"))


def code_text(response: Column) -> Column:
    """The code of a response: without thinking, out of its fence, dedented."""
    return T.dedented(T.fenced_code(T.without_thinking(response)))


def score(df: DataFrame, key: str, domain: str, response: str, reference: str, kinds: dict[str, str], tests: str | None = None, strict: bool = False, limits: C.Limits = C.Limits()) -> DataFrame:
    """(key, domain, correct, canonical): ``kinds`` says how a domain is scored: number, choice, text or code.

    Numbers, choices and texts are scored by Column expressions in one pass.  Only rows of code domains go to the limited
    interpreter, and only if ``tests`` names their column of tests.  A null response is wrong; a domain without a kind has null.
    """
    r, ref = F.coalesce(F.col(response), F.lit("")), F.col(reference)
    of = lambda kind: F.col(domain).isin([d for d, k in kinds.items() if k == kind])
    plain = F.struct(F.coalesce(T.squash(r) == T.squash(ref), F.lit(False)).alias("correct"), (r != "").alias("canonical"))
    made = F.when(of("number"), number_score(r, ref, strict)).when(of("choice"), choice_score(r, ref, "strict" if strict else "explicit")).when(of("text"), plain)
    out = df.select(key, domain, made.alias("_s")).select(key, domain, "_s.correct", "_s.canonical")
    if tests is None:
        return out
    ran = C.execute(df.filter(of("code")).select(key, code_text(r).alias("_code"), tests), key, "_code", tests, limits=limits)
    ran = ran.select(key, (F.col("status") == "passed").alias("_correct"), (~F.col("status").isin("unsafe", "invalid_tests")).alias("_canonical"))
    both = out.join(ran, key, "left")
    return both.select(key, domain, F.coalesce("correct", "_correct").alias("correct"), F.coalesce("canonical", "_canonical").alias("canonical"))


def routed(requests: DataFrame, routes: DataFrame, outputs: DataFrame, key: str, domain: str, model: str) -> DataFrame:
    """The output of the model that a domain is routed to, for each request; ``routes`` has one model a domain.

    A request without a route or without an output of its model has a null response.
    """
    picked = requests.join(F.broadcast(routes.limit(10_000).dropDuplicates([domain])), domain, "left")
    return picked.join(outputs, [key, model], "left")


def verified_or(df: DataFrame, generated: str, given: str, correct: str, name: str = "answer") -> DataFrame:
    """The generated answer where it is correct, else the given one; ``<name>_from`` says which, null where there is neither."""
    good = F.coalesce(F.col(correct), F.lit(False)) & F.col(generated).isNotNull()
    return df.withColumns({name: F.when(good, F.col(generated)).otherwise(F.col(given)), f"{name}_from": F.when(good, F.lit("generated")).when(F.col(given).isNotNull(), F.lit("given"))})


def first_token_latency(events: DataFrame, request: str, text: str, time: str) -> DataFrame:
    """(request, first_event_ms, first_token_ms, events): delays of a token stream from its first row, which is the request itself.

    Rows without text are events but no tokens.  Map-side combined, so a long stream costs one row a task.
    """
    at = F.unix_micros(time)
    said = F.coalesce(F.col(text), F.lit("")) != ""
    by = events.groupBy(request).agg(
        F.min(at).alias("_t"), F.min(F.when(F.col(text).isNotNull(), at)).alias("_e"), F.min(F.when(said, at)).alias("_k"), F.count(text).alias("events")
    )
    return by.select(request, ((F.col("_e") - F.col("_t")) / F.lit(1000.0)).alias("first_event_ms"), ((F.col("_k") - F.col("_t")) / F.lit(1000.0)).alias("first_token_ms"), "events")
