"""Numbers, choices, labels and JSON out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"
_ALL = F.lit


def named(c: Column, f) -> Column:
    """f(c) with the value of ``c`` computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, _ALL(f"({NUMBER})"), _ALL(1))


def _after_mark(c: Column) -> Column:
    """What stands behind the last ####, null without one."""
    return F.when(F.contains(c, F.lit("####")), F.substring_index(c, "####", -1))


def plain_number(c: Column) -> Column:
    """Without commas and one trailing .0."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), ",", ""), r"\.0$", "")


def canonical_number(c: Column) -> Column:
    """Without commas, sign +, leading and trailing zeros; -0 is 0; null if it is no plain decimal number."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), ",", ""), r"^\+", "")
    s = F.regexp_replace(s, r"^(-?)0+(?=\d)", "$1")
    s = F.when(F.contains(s, F.lit(".")), F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s)
    return F.when(F.regexp_replace(F.trim(c), ",", "").rlike(r"^[-+]?\d+(\.\d*)?$"), F.when(s == "-0", "0").otherwise(s))


_EXPONENT = r"[-+]?(?:\d[\d,]*\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def decimal_number(c: Column) -> Column:
    """As canonical_number, for numbers with an exponent or a leading point too; written without an exponent (20 digits before
    and 18 behind the point); null if it is no finite number of that size."""
    plain = F.regexp_replace(F.trim(c), ",", "")
    fixed = named(plain, lambda x: F.when(x.rlike(rf"^{_EXPONENT}$"), x.try_cast("decimal(38,18)")))
    # Spark writes small decimals with an exponent; format_number does not, but groups the digits
    full = named(fixed, lambda d: F.when(d.cast("string").contains("E"), F.regexp_replace(F.format_number(d, 18), ",", "")).otherwise(d.cast("string")))
    return named(full, canonical_number)


def number(c: Column, strict: bool = False) -> Column:
    """struct(value, canonical): a number in one form, and whether the text has it behind its last mark ####.

    Behind the mark nothing but the number may stand for it to be canonical.  ``strict`` asks for a canonical one, otherwise
    the last number of the text serves too.
    """
    marked = named(F.trim(_after_mark(c)), lambda t: F.when(t.rlike(rf"^\$?{_EXPONENT}\.?$"), decimal_number(F.regexp_replace(t, r"^\$|\.$", ""))))
    last = decimal_number(F.regexp_replace(F.try_element_at(F.regexp_extract_all(c, _ALL(f"({_EXPONENT})"), _ALL(1)), F.lit(-1)), r"\.$", ""))
    return named(marked, lambda m: F.struct((m if strict else F.coalesce(m, last)).alias("value"), m.isNotNull().alias("canonical")))


def last_number(c: Column) -> Column:
    """Last number behind the last ####; a placeholder there falls back to the text before it; else the last number at all."""
    tail = _after_mark(c)
    head = F.substr(c, F.lit(1), F.length(c) - F.length(tail) - 4)
    scope = F.when(tail.isNull(), c).when(F.contains(tail, F.lit("<number>")), head).otherwise(tail)
    return plain_number(F.try_element_at(_numbers(scope), F.lit(-1)))


def marked_number(c: Column) -> Column:
    """First number behind the last ####, else the last number of the whole text."""
    return plain_number(F.coalesce(F.try_element_at(_numbers(_after_mark(c)), F.lit(1)), F.try_element_at(_numbers(c), F.lit(-1))))


def final_choice(c: Column) -> Column:
    """Letter A to D: last explicit final answer, else last chosen letter, else last letter that stands alone."""
    up = F.upper(c)
    steps = [r"(?:最终答案|答案|FINAL ANSWER|ANSWER)\s*(?:是|为|IS)?\s*[:：]?\s*\(?([A-D])(?![A-Z])", r"选(?:择)?\s*([A-D])(?![A-Z])", r"(?:^|[^A-Z])([A-D])(?![A-Z])"]
    return F.coalesce(*[F.try_element_at(F.regexp_extract_all(up, F.lit(p), F.lit(1)), F.lit(-1)) for p in steps])


def choice(c: Column, variant: str) -> Column:
    """A letter A to D: ``strict`` (last line only), ``stated`` (last explicit final answer), ``first`` (first letter that stands
    alone), ``isolated`` (last one), ``explicit`` (all of final_choice)."""
    if variant == "strict":
        return strict_choice(c)
    if variant == "explicit":
        return final_choice(c)
    pattern, at = {
        "stated": (r"(?:最终答案|答案|FINAL ANSWER|ANSWER)\s*(?:是|为|IS)?\s*[:：]?\s*\(?([A-D])(?:[^A-Z]|$)", -1),
        "first": (r"(?:^|[^A-Z])([A-D])(?:[^A-Z]|$)", 1), "isolated": (r"(?:^|[^A-Z])([A-D])(?:[^A-Z]|$)", -1),
    }[variant]
    return F.try_element_at(F.regexp_extract_all(F.upper(c), F.lit(pattern), F.lit(1)), F.lit(at))


def strict_choice(c: Column) -> Column:
    """The letter of a last line of the form 最终答案：X, null otherwise."""
    last = F.trim(F.substring_index(F.regexp_replace(c, r"\s+$", ""), "\n", -1))
    letter = F.regexp_extract(last, r"^最终答案：([A-D])$", 1)
    return F.when(letter != "", letter)


def unanimous_label(c: Column, patterns: list[str]) -> Column:
    """The one letter all patterns agree on, null if none or several."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(F.upper(c), F.lit(p), F.lit(1)) for p in patterns]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def choice_options(c: Column) -> Column:
    """Texts of the options A to D in order, null unless all four markers follow each other."""
    pattern = r"(?s)(?:^|\n)\s*A[.、:：]\s*(.*?)\s*\n\s*B[.、:：]\s*(.*?)\s*\n\s*C[.、:：]\s*(.*?)\s*\n\s*D[.、:：]\s*(.*?)\s*(?:\n|$)"
    return F.when(c.rlike(pattern), F.array(*[F.regexp_extract(c, pattern, i) for i in (1, 2, 3, 4)]))


def choice_letter(c: Column) -> Column:
    """0 to 3, a letter, or OPTION letter as a letter."""
    s = F.regexp_replace(F.upper(F.trim(c)), r"^OPTION\s+", "")
    return F.when(s.rlike("^[0-3]$"), F.substr(F.lit("ABCD"), s.try_cast("int") + 1, F.lit(1))).when(s.rlike("^[A-D]$"), s)


def reason_and_letter(c: Column) -> Column:
    """struct(reason, letter): the answer split at its final letter line."""
    letter = strict_choice(c)
    reason = F.regexp_replace(F.regexp_replace(c, r"(?s)\n?最终答案：[A-D]\s*$", ""), r"[\s。；;，,]+$", "")
    return F.struct(F.when(letter.isNotNull(), reason).otherwise(c).alias("reason"), letter.alias("letter"))


def json_text(c: Column) -> Column:
    """The JSON object inside a model's reply: without fences, first brace to last brace; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(c, r"(?i)```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def balanced_json(text: str | None) -> str | None:
    """The first JSON object of a text that parses, found by matching braces outside strings; a comma before a closing bracket is
    left out.  Null if there is none."""
    import json
    import re

    for start in (i for i, ch in enumerate(text or "") if ch == "{"):
        depth, quoted, skip = 0, False, False
        for at in range(start, len(text)):
            ch = text[at]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = True
            elif ch in "{}":
                depth += 1 if ch == "{" else -1
                if not depth:
                    for body in (text[start : at + 1], re.sub(r",(\s*[}\]])", r"\1", text[start : at + 1])):
                        try:
                            return json.dumps(json.loads(body), ensure_ascii=False, sort_keys=True)
                        except ValueError:
                            continue
                    break
    return None


def repaired_json(c: Column) -> Column:
    """balanced_json as a Column, in Arrow batches; for replies that json_text does not parse."""
    import pandas as pd

    return F.pandas_udf(lambda s: pd.Series([balanced_json(t) for t in s], dtype=object), "string")(c)


def rank_of(c: Column, order: list[str], unknown: int = 0) -> Column:
    """Place of a value in a list, from 1; ``unknown`` for any other."""
    return F.coalesce(*[F.when(c == v, F.lit(i)) for i, v in enumerate(order, 1)], F.lit(unknown))


def near(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance


def megabytes(c: Column, binary: bool = False) -> Column:
    """Bytes as decimal megabytes, or as mebibytes."""
    return c / F.lit(float(1 << 20) if binary else 1e6)


def iso_time(seconds: Column) -> Column:
    """Seconds since 1970 as UTC text."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def now_iso() -> Column:
    """The time of the query, the same on every row."""
    return iso_time(F.unix_timestamp(F.current_timestamp()))


def json_field(c: Column, path: str) -> Column:
    return F.get_json_object(json_text(c), path)


def string_list(c: Column) -> Column:
    """A JSON array of strings as an array, null if it is none or empty."""
    out = F.from_json(c, "array<string>")
    return F.when(F.size(out) > 0, out)


def first_field(m: Column, names: list[str]) -> Column:
    """Value of the first of several synonymous keys of a map, keys compared without letter case."""
    low = F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(F.trim(e["key"])), e["value"])))
    return F.coalesce(*[F.try_element_at(low, F.lit(n)) for n in names])
