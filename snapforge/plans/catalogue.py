"""All queries of the engine's own operators, with their DuckDB equivalents, by operator and name."""

from functools import partial

from .dialect import run, to_duckdb
from .frame_queries import FRAMES
from .model_queries import MODELS
from .sql_queries import SQL
from .tier_queries import TIERS


def _sql(text, spark, sf_dir):
    return run(spark, sf_dir, text)


_BUILT = FRAMES | TIERS | MODELS
QUERIES: dict = {name: partial(_sql, text) for name, text in SQL.items()} | {name: f for name, (f, _) in _BUILT.items()}
ORACLES: dict = {name: to_duckdb(text) for name, text in SQL.items()} | {name: sql for name, (_, sql) in _BUILT.items() if sql}
