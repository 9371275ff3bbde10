"""Text normalisation, tokens and n-grams as Column expressions (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\p{L}\p{N}_]+"
TOKEN = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+|[一-鿿]"
UNIT_END = "。！？!?；;\n"


def fold(c: Column) -> Column:
    """Case folding: lower case, and ß as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def squash(c: Column) -> Column:
    """Letters, digits and underscores only, folded: the identity used for exact duplicates."""
    return fold(F.regexp_replace(c, WORD, ""))


def squash_letters(c: Column) -> Column:
    """As squash, without underscores."""
    return fold(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def spaced(c: Column) -> Column:
    """White space runs as one blank, no outer blanks."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def spaced_fold(c: Column) -> Column:
    return fold(spaced(c))


def choice_identity(question: Column, options: Column) -> Column:
    """SHA-256 of a question and its options, folded and joined by blanks."""
    return F.sha2(fold(F.concat_ws(" ", question, options)), 256)


def word_tokens(c: Column) -> Column:
    """Identifiers, numbers and single Chinese characters of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(f"({TOKEN})"), F.lit(1))


def grams(tokens: Column, n: int = 4) -> Column:
    """Distinct n-grams joined by blanks; a shorter list is one gram, an empty list none."""
    size = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(F.array_join(tokens, " "))).otherwise(F.array_distinct(many))


def gram_jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), either), F.lit(0.0))


def han_count(c: Column) -> Column:
    """Chinese characters, U+3400 to U+9FFF."""
    return F.regexp_count(c, F.lit("[㐀-鿿]"))


def units(c: Column) -> Column:
    """The text cut behind sentence ends; joining the units gives the text back."""
    return F.split(c, rf"(?<=[{UNIT_END}])", -1)


def fenced_code(c: Column) -> Column:
    """Body of the first code fence, or the text itself without outer blanks."""
    body = F.regexp_extract(c, r"(?is)```(?:python)?\s*(.*?)```", 1)
    return F.when(c.rlike(r"(?is)```(?:python)?\s*.*?```"), F.trim(F.regexp_replace(body, r"\s+$", ""))).otherwise(F.trim(c))


def without_thinking(c: Column) -> Column:
    """The text without think envelopes; one that is never closed takes the rest of the text, one never opened the start."""
    shut = F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)^.*?</think>", "")
    return F.trim(F.regexp_replace(shut, r"(?is)<think>.*$", ""))


def dedented(c: Column) -> Column:
    """The text without the white space that all its non-blank lines begin with."""
    lines = F.split(c, "\n", -1)
    lead = F.transform(F.filter(lines, lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != ""), lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0)))
    cut = F.coalesce(F.array_min(lead), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substr(x, F.least(cut, F.length(F.regexp_extract(x, r"^[ \t]*", 0))) + 1)), "\n")


def without_frame(c: Column, prefixes: list[str], suffixes: list[str]) -> Column:
    """The text without the listed boilerplate at its start and end."""
    for p in prefixes:
        c = F.when(F.startswith(c, F.lit(p)), F.substr(c, F.lit(len(p) + 1))).otherwise(c)
    for s in suffixes:
        c = F.when(F.endswith(c, F.lit(s)), F.substr(c, F.lit(1), F.length(c) - len(s))).otherwise(c)
    return F.trim(c)


def first_sentences(c: Column, count: int = 2, limit: int = 180) -> Column:
    """The first sentences, cut to a number of characters."""
    parts = F.regexp_extract_all(c, F.lit(r"([^。！？!?]*[。！？!?]?)"), F.lit(1))
    return F.substr(F.trim(F.array_join(F.slice(F.filter(parts, lambda p: F.trim(p) != ""), 1, count), "")), F.lit(1), F.lit(limit))


def render_chat(messages: Column) -> Column:
    """Messages with content as <|im_start|>role lines."""
    said = F.filter(messages, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) != "")
    return F.array_join(F.transform(said, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.trim(m["content"]), F.lit("<|im_end|>"))), "\n")


def last_user(messages: Column) -> Column:
    """Content of the last user message, null if there is none."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]


def only_roles(messages: Column, *roles: str) -> Column:
    return F.filter(messages, lambda m: m["role"].isin(*roles))
