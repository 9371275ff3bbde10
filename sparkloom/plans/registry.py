"""Registration of catalogue queries with their SQL, and SQL pieces that mirror Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# SQL pieces that mirror the Column functions
SPACE = r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def squash(c: str) -> str:
    return fold(f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')")


def spaced(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"regexp_extract_all({fold(c)}, '[A-Za-z_][\\p{{L}}\\p{{N}}_]*|\\p{{Nd}}+|[一-鿿]')"


def grams(t: str, n: int = 4) -> str:
    return (
        f"CASE WHEN len({t}) = 0 THEN [] WHEN len({t}) < {n} THEN [array_to_string({t}, ' ')] "
        f"ELSE list_distinct(list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))) END"
    )


def hash_order(seed: object, key: str) -> str:
    return f"sha256(concat_ws(':', '{seed}', {key}))"


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.rstrip("_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
