"""JSON feeds: which source has which schema, how its documents are flattened to records, and what to do with those that don't fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import records


def listed(docs: DataFrame, of: str = "cards") -> DataFrame:
    """{"data": {set: {of: [record, ...]}}} to (set, record)."""
    sets = docs.select(F.explode(F.from_json("value", f"data map<string, struct<{of}: array<string>>>")["data"]).alias("set", "x"))
    return sets.select("set", F.explode(f"x.{of}").alias("record"))


def keyed(docs: DataFrame, key: str = "uuid") -> DataFrame:
    """{"data": {key: record, ...}} to (key, record)."""
    return docs.select(F.explode(F.from_json("value", "data map<string, string>")["data"]).alias(key, "record"))


def plain(docs: DataFrame) -> DataFrame:
    """[record, ...] to (record)."""
    return docs.select(F.explode(F.from_json("value", "array<string>")).alias("record"))


@dataclass(frozen=True)
class Feed:
    schema: str  # as DDL
    flatten: Callable[[DataFrame], DataFrame]


LISTING = "map<string,map<string,double>>"
PRICES = ", ".join(f"{n}: string" for n in ("usd", "usd_foil", "usd_etched", "eur", "eur_foil", "eur_etched", "tix"))
REGISTRY: dict[str, Feed] = {
    "cards": Feed("uuid string, name string, setCode string, number string, language string, layout string, rarity string, identifiers map<string,string>, legalities map<string,string>, finishes array<string>", listed),
    "prices": Feed(f"paper map<string,struct<buylist:{LISTING},retail:{LISTING},currency:string>>", keyed),
    "prints": Feed(f"id string, oracle_id string, name string, lang string, layout string, rarity string, legalities map<string,string>, edhrec_rank double, prices struct<{PRICES}>", plain),
}


def load(spark: SparkSession, path: str, feed: str | Feed) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of the feed's file or folder, each file a document."""
    return flatten(spark.read.text(path, wholetext=True), feed)


def flatten(docs: DataFrame, feed: str | Feed) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of documents in the column value."""
    feed = REGISTRY[feed] if isinstance(feed, str) else feed
    return records(feed.flatten(docs), feed.schema)


def scalar_prices(prints: DataFrame, day: str) -> DataFrame:
    """(id, snapshot_date, eur, eur_foil, usd, usd_foil, tix) of the records' price struct; what is no number is null."""
    number = lambda c: F.col(f"prices.{c}").cast("string").try_cast("double").alias(c)
    return prints.select("id", F.to_date(F.lit(day)).alias("snapshot_date"), *map(number, ("eur", "eur_foil", "usd", "usd_foil", "tix")))


def daily(rows: DataFrame, key: str, columns: list[str], day: str) -> DataFrame:
    """A day's snapshot of some columns."""
    return rows.select(key, F.to_date(F.lit(day)).alias("snapshot_date"), *columns)
