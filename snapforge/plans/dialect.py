"""Spark SQL texts of the catalogue, and their DuckDB equivalents.

A catalogue text is Spark SQL with tables in braces. `to_duckdb` rewrites the few calls whose names or argument orders differ; all
else in the texts means the same in both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_REWRITES = {
    "datediff": lambda a: f"date_diff('day', {a[1]}, {a[0]})",
    "date_add": lambda a: f"CAST({a[0]} + INTERVAL ({a[1]}) DAY AS DATE)",
    "get_json_object": lambda a: f"json_extract_string({a[0]}, {a[1]})",
    "size": lambda a: f"CAST(len({a[0]}) AS INT)",
    "array": lambda a: f"list_value({', '.join(a)})",
    "array_contains": lambda a: f"list_contains({a[0]}, {a[1]})",
    "split": lambda a: f"string_split({a[0]}, {a[1]})",
    "transform": lambda a: f"list_transform({a[0]}, {_lambda(a[1])})",
    "filter": lambda a: f"list_filter({a[0]}, {_lambda(a[1])})",
    "array_join": lambda a: f"array_to_string({a[0]}, {a[1]})",
    "locate": lambda a: f"CAST(strpos({a[1]}, {a[0]}) AS INT)",
    "startswith": lambda a: f"starts_with({a[0]}, {a[1]})",
    "double": lambda a: f"CAST({a[0]} AS DOUBLE)",
    "bigint": lambda a: f"CAST({a[0]} AS BIGINT)",
    "percentile": lambda a: f"quantile_cont({a[0]}, {a[1]})",
    "regexp_extract": lambda a: f"regexp_extract({', '.join(a)})",
    "explode": lambda a: f"unnest({a[0]})",
    "sequence": lambda a: f"generate_series({a[0]}, {a[1]})",
    "xxhash_text": lambda a: f"md5({a[0]})",
    "format_string": lambda a: f"printf({', '.join(a)})",
    "any_match": lambda a: f"(len(list_filter({a[0]}, {_lambda(a[1])})) > 0)",
}
_SPARK = {"xxhash_text": lambda a: f"md5({a[0]})", "any_match": lambda a: f"exists({a[0]}, {a[1]})"}
_CALL = re.compile(r"\b(" + "|".join(_REWRITES) + r")\(")


def _lambda(text: str) -> str:
    name, body = text.split("->", 1)
    return f"lambda {name.strip()}: {body.strip()}"


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose open parenthesis is before `at`, and the place after its close."""
    out, depth, start, quoted = [], 0, at, False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c == "(":
            depth += 1
        elif c == ")" and depth:
            depth -= 1
        elif c == ")" or (c == "," and not depth):
            out.append(text[start:i].strip())
            start = i + 1
            if c == ")":
                return out, i + 1
    raise ValueError(f"unbalanced: {text[at:]}")


def _rewrite(text: str, rules: dict) -> str:
    out, at = [], 0
    while m := _CALL.search(text, at):
        arguments, end = _arguments(text, m.end())
        arguments = [_rewrite(a, rules) for a in arguments]
        rule = rules.get(m[1])
        out += [text[at : m.start()], rule(arguments) if rule else f"{m[1]}({', '.join(arguments)})"]
        at = end
    return "".join(out) + text[at:]


def to_duckdb(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", _rewrite(text, _REWRITES))


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(_rewrite(text, _SPARK), **used)
