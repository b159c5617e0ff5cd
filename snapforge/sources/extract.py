"""Extraction: nested price maps to price points, and HTML tables and lists to rows, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.expr import any_date

LISTING = "map<string,map<string,double>>"
PRICE_MAP = f"map<string,struct<buylist:{LISTING},retail:{LISTING},currency:string>>"


def price_points(feed: DataFrame) -> DataFrame:
    """feed (uuid, paper map) to (uuid, retailer, tx_type, finish, date, price); any finish counts, other sides don't."""
    shops = feed.select("uuid", F.explode("paper").alias("retailer", "shop"))
    sides = F.array(*[F.struct(F.lit(s).alias("tx_type"), F.col(f"shop.{s}").alias("finishes")) for s in ("buylist", "retail")])
    rows = shops.select("uuid", "retailer", F.inline(sides)).select("uuid", "retailer", "tx_type", F.explode("finishes").alias("finish", "by_date"))
    return rows.select("uuid", "retailer", "tx_type", "finish", F.explode("by_date").alias("date", "price")).withColumn("date", F.to_date("date"))


_COMBO = ("uuid", "retailer", "tx_type", "finish")


def latest_points(points: DataFrame, day: str, quarantine: bool = False) -> DataFrame:
    """The last price at or before the day of each combination. A null there is an error, not a reason to look further back: the query
    fails, or with quarantine the combination is left out (see broken_points)."""
    rows = _winners(points, day)
    if quarantine:
        return rows.where("price IS NOT NULL")
    return rows.withColumn("price", F.coalesce("price", F.raise_error(F.concat(F.lit("null price at the winning date of "), F.concat_ws("/", *_COMBO))).cast("double")))


def broken_points(points: DataFrame, day: str) -> DataFrame:
    """The combinations whose last price is null."""
    return _winners(points, day).where("price IS NULL").drop("price")


def _winners(points: DataFrame, day: str) -> DataFrame:
    rows = points.where(F.col("date") <= F.to_date(F.lit(day))).groupBy(*_COMBO).agg(F.max(F.struct("date", "price")).alias("x"))
    return rows.select("uuid", F.to_date(F.lit(day)).alias("snapshot_date"), "retailer", "tx_type", "finish", F.col("x.price").alias("price"))


def seed_points(points: DataFrame) -> DataFrame:
    """All dates' prices, without nulls."""
    return points.where("price IS NOT NULL").select("uuid", F.col("date").alias("snapshot_date"), "retailer", "tx_type", "finish", "price")


def _text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), "&amp;", "&"))


def elements(html: Column, tag: str) -> Column:
    """The inner HTML of all elements of a tag that holds none of its own kind."""
    return F.regexp_extract_all(html, F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def table_rows(pages: DataFrame, id_col: str, html_col: str, least: int = 1) -> DataFrame:
    """(id, row, cells) of the table rows with at least so many cells."""
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(elements(F.col(html_col), "tr")).alias("row", "html"))
    return rows.select("id", "row", F.transform(elements(F.col("html"), "td"), _text).alias("cells")).where(F.size("cells") >= least)


def staples(pages: DataFrame, format_: str) -> DataFrame:
    """Rows of at least five cells: rank, name, share in %, played; those that don't parse are skipped."""
    cells = F.col("cells")
    pct = F.expr("try_cast(replace(replace(cells[2], '%', ''), ',', '') AS double)")
    rows = table_rows(pages, "id", "html", 5).select(F.expr("try_cast(cells[0] AS int)").alias("top"), cells[1].alias("card_name"), pct.alias("deck_pct"), F.expr("try_cast(replace(cells[3], ',', '') AS double)").alias("played"))
    rows = rows.where("top IS NOT NULL AND deck_pct IS NOT NULL AND played IS NOT NULL").withColumn("percentage_in_decks", F.col("deck_pct").cast("int"))
    return rows.select(F.concat_ws("__", "card_name", F.lit(format_)).alias("id"), "card_name", F.lit(format_).alias("format"), "deck_pct", "percentage_in_decks", "played", "top")


def tournaments(pages: DataFrame) -> DataFrame:
    """Event links (?e=number) with the date in the row's last cell; of an event's rows the first, by page id and place."""
    rows = pages.select("id", F.posexplode(elements(F.col("html"), "tr")).alias("row", "tr"))
    rows = rows.select("id", "row", F.regexp_extract("tr", "e=(\\d+)", 1).alias("tournament_id"), _text(F.get(elements(F.col("tr"), "a"), F.lit(0))).alias("event_name"), any_date(_text(F.element_at(elements(F.col("tr"), "td"), -1))).alias("tournament_date"))
    first = rows.where("tournament_id <> ''").groupBy("tournament_id").agg(F.min_by(F.struct("id", "row", "event_name", "tournament_date"), F.struct("id", "row")).alias("x"))
    return first.select("x.id", "x.row", "tournament_id", "x.event_name", "x.tournament_date")


def top_tournaments(found: DataFrame, most: int) -> DataFrame:
    """(format, tournament_id, ...): of each format's page the first events; one that several formats list counts for the first format."""
    once = W.Window.partitionBy("tournament_id").orderBy("format", "row")
    rows = found.withColumn("n", F.row_number().over(once)).where("n = 1")
    return rows.withColumn("n", F.row_number().over(W.Window.partitionBy("format").orderBy("row", "tournament_id"))).where(F.col("n") <= most).drop("n")


def decks(pages: DataFrame, most: int = 8) -> DataFrame:
    """Deck links (d=number) in the order of the page: placements 1 to 8."""
    rows = pages.select("id", F.posexplode(F.array_distinct(F.regexp_extract_all("html", F.lit("d=(\\d+)"), F.lit(1)))).alias("n", "deck_id"))
    return rows.select("id", (F.col("n") + 1).alias("placement"), "deck_id").where(F.col("placement") <= most)


def decklist(pages: DataFrame) -> DataFrame:
    """Lines `<div id="md..."|"sb...">4 Name</div>` to copies, card and board."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit('(?is)<div[^>]*id="?(md|sb)[^>]*>(.*?)</div>'), F.lit(1)).alias("board"), F.regexp_extract_all("html", F.lit('(?is)<div[^>]*id="?(md|sb)[^>]*>(.*?)</div>'), F.lit(2)).alias("line"))
    rows = pages.select("id", F.inline(found)).select("id", "board", _text(F.col("line")).alias("line"))
    return rows.select("id", F.regexp_extract("line", "^(\\d+)\\s+(.+)$", 1).alias("copies"), F.regexp_extract("line", "^(\\d+)\\s+(.+)$", 2).alias("card_name"), F.startswith("board", F.lit("sb")).alias("is_sideboard")).where("copies <> ''").withColumn("copies", F.col("copies").cast("int"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href) of every link of every page."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?i)<a[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", _text(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))
