"""Rows of a training or evaluation set from raw columns: messages, prompts, ids, repaired answers, nested decision records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

MESSAGES = "array<struct<role: string, content: string>>"


def messages(**roles: Column) -> Column:
    """Messages in the order given, without those that are null or blank."""
    said = F.array(*[F.struct(F.lit(role).alias("role"), c.cast("string").alias("content")) for role, c in roles.items()])
    return F.filter(said, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) != "")


def training_row(df: DataFrame, key: str, prompt: Column, answer: Column, system: Column | None = None, **fixed: Column) -> DataFrame:
    """(key, messages, answer, fixed columns): the canonical row of a record."""
    said = messages(**({"system": system} if system is not None else {}), user=prompt, assistant=answer)
    return df.select(key, said.alias("messages"), answer.alias("answer"), *[c.alias(n) for n, c in fixed.items()])


def evaluation_row(df: DataFrame, key: str, prompt: Column, reference: Column, system: Column | None = None, **fixed: Column) -> DataFrame:
    """(key, messages, reference, fixed columns): as training_row, with the answer kept out of the messages."""
    said = messages(**({"system": system} if system is not None else {}), user=prompt)
    return df.select(key, said.alias("messages"), reference.alias("reference"), *[c.alias(n) for n, c in fixed.items()])


def with_defaults(df: DataFrame, defaults: dict[str, Column], drop: list[str] = ()) -> DataFrame:
    """Columns set where they are null or absent; the listed ones dropped."""
    have = set(df.columns)
    return df.withColumns({n: F.coalesce(F.col(n), c) if n in have else c for n, c in defaults.items()}).drop(*drop)


def only_user(said: Column) -> Column:
    """Content of the one user message; an error if there is none or there are several."""
    mine = T.only_roles(said, "user")
    many = F.raise_error(F.concat(F.lit("user messages: "), F.coalesce(F.size(mine), F.lit(0)).cast("string"))).cast("string")
    return F.when(F.size(mine) == 1, F.get(mine, F.lit(0))["content"]).otherwise(many)


def choice_prompt(question: Column, options: Column, instruction: Column | None = None) -> Column:
    """The question, its options as lines A. to Z., and an instruction."""
    letter = lambda i: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i + F.lit(1), F.lit(1))
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(letter(i), F.lit(". "), o)), "\n")
    return F.concat_ws("\n", question, lines, *([instruction] if instruction is not None else []))


def by_key(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The instruction that a table has for a domain."""
    out = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], F.lit(default))
    return out


def with_public_tests(prompt: Column, tests: Column, first: int = 3, lead: str = "\n\n") -> Column:
    """The prompt followed by the first tests, one a line; the prompt alone if there is none."""
    shown = F.slice(tests, 1, first)
    return F.when(F.size(shown) > 0, F.concat(prompt, F.lit(lead), F.array_join(shown, "\n"))).otherwise(prompt)


def swap_prefix(key: Column, old: str, new: str) -> Column:
    return F.when(F.startswith(key, F.lit(old)), F.concat(F.lit(new), F.substr(key, F.lit(len(old) + 1)))).otherwise(key)


def last_part(key: Column, mark: str = "/") -> Column:
    return F.substring_index(key, mark, -1)


def hashed_key(prefix: str, *cols: Column, digits: int = 16) -> Column:
    """prefix and the first hex digits of the SHA-256 of the columns joined by colons."""
    return F.concat(F.lit(prefix), F.substr(F.sha2(F.concat_ws(":", *cols), 256), F.lit(1), F.lit(digits)))


def first_present(*cols: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def with_mark(answer: Column, value: Column, mark: str = "####") -> Column:
    """The answer with a last line ``mark value`` where it has no mark and the value is known."""
    lacks = ~F.contains(answer, F.lit(mark)) & (F.coalesce(F.trim(value), F.lit("")) != "")
    return F.when(lacks, F.concat(F.rtrim(answer), F.lit(f"\n{mark} "), F.trim(value))).otherwise(answer)


def clipped(texts: Column, length: int = 240, count: int = 5) -> Column:
    """The first ``count`` texts, each cut to ``length`` characters, without outer blanks."""
    return F.transform(F.slice(texts, 1, count), lambda t: F.substr(F.trim(t), F.lit(1), F.lit(length)))


def decision_record(c: Column, actions: list[str], required: list[str]) -> Column:
    """struct(action, confidence, problems) of a JSON decision: which required fields are missing or out of range."""
    field = lambda n: F.get_json_object(c, f"$.{n}")
    action, sure = field("action"), field("confidence").try_cast("double")
    checks = [(f"no_{n}", field(n).isNull()) for n in required] + [
        ("action", action.isNotNull() & ~action.isin(*actions)), ("confidence", field("confidence").isNotNull() & ~F.coalesce((sure >= 0) & (sure <= 1), F.lit(False)))
    ]
    problems = F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(n)) for n, x in checks]), lambda x: x.isNotNull())
    return F.struct(action.alias("action"), sure.alias("confidence"), problems.alias("problems"))
