"""Feature tier: price and card features, language premiums, demand signals, events and their impact, staples, tournaments, the training frame.

Every builder takes and returns DataFrames and shuffles once by its key; windows of one key share that exchange. Columns have the
names that the tables of this tier are known by. A column or table that is missing gives null columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.expr import capped, direction, ratio
from .windows import history, last, so_far

FORMATS = ("commander", "standard", "modern", "legacy", "vintage")


def with_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """rows with a null column of the type for each wanted one that is missing."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in rows.columns})


# ---------------------------------------------------------------- prices and cards

LISTED = {c: "double" for c in ("eur_foil", "usd", "usd_foil", "cardmarket_eur", "cardmarket_eur_foil", "tcgplayer_usd", "tcgplayer_usd_foil")}


def price_features(prices: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """prices (uuid, scryfall_id?, snapshot_date, eur, ...) with edhrec_rank of the day, changes over 1, 7 and 30 rows, rolling and
    expanding figures, the day's rank and the spike flag. Rows without a uuid go first, so that they are nobody's lag."""
    rows = with_columns(prices.where("uuid IS NOT NULL"), {"scryfall_id": "string"} | LISTED).select("uuid", "scryfall_id", "snapshot_date", "eur", *LISTED)
    if meta is None:
        rows = rows.withColumn("edhrec_rank", F.lit(None).cast("double"))
    else:
        ranks = meta.select(F.col("id").alias("scryfall_id"), "snapshot_date", F.col("edhrec_rank").cast("double").alias("edhrec_rank"))
        rows = rows.join(ranks, ["scryfall_id", "snapshot_date"], "left").select(*rows.columns, "edhrec_rank")
    eur, w = F.col("eur"), history()
    lag = {n: F.lag("eur", n).over(w) for n in (1, 7, 30)}
    seen = F.max(F.when(eur.isNotNull(), F.col("snapshot_date"))).over(so_far())
    rows = rows.withColumns(
        {"price_7d_avg": F.avg("eur").over(last(7)), "price_30d_avg": F.avg("eur").over(last(30))}
        | {f"price_change_{n}d_abs": eur - lag[n] for n in lag}
        | {f"price_change_{n}d_pct": ratio(eur - lag[n], lag[n]) for n in lag}
        | {
            "price_volatility_30d": F.stddev_samp("eur").over(last(30)), "foil_premium": ratio(F.col("eur_foil"), eur),
            "price_ath": F.max("eur").over(so_far()), "price_atl": F.min("eur").over(so_far()), "days_with_price": F.count("eur").over(so_far()),
            "days_since_last_real_price": F.datediff("snapshot_date", seen),
        }
    )
    rank = F.rank().over(W.Window.partitionBy("snapshot_date").orderBy(F.col("eur").desc_nulls_last()))
    return rows.withColumns({"price_rank_global": rank, "is_price_spike": F.abs("price_change_1d_pct") > 3.0})


#: Columns of a card that are handed on, and their types where a catalogue lacks them.
CARD_COLUMNS = {
    "uuid": "string", "scryfall_id": "string", "oracle_id": "string", "name": "string", "set_code": "string", "rarity": "string", "mana_value": "double", "is_reserved": "boolean", "is_reprint": "boolean",
    "is_promo": "boolean", "is_full_art": "boolean", "is_textless": "boolean", "edhrec_saltiness": "double", "set_type": "string",
}
LEGALITY_COLUMNS = {"is_commander_legal": "boolean", "is_standard_legal": "boolean", "is_modern_legal": "boolean", "is_legacy_legal": "boolean", "format_count": "int"}
LIST_COLUMNS = dict.fromkeys(("finishes", "colors", "color_identity", "variations", "original_supertypes"), "array<string>")


def card_features(cards: DataFrame) -> DataFrame:
    """One row a card with a uuid: its attributes, counts of list items, flags, mana value up to 20, and how many rows share its oracle id."""
    rows = with_columns(cards.where("uuid IS NOT NULL"), CARD_COLUMNS | LEGALITY_COLUMNS | LIST_COLUMNS)
    items = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    holds = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    prints = F.when(F.col("oracle_id").isNull(), 1).otherwise(F.count(F.lit(1)).over(W.Window.partitionBy("oracle_id"))).cast("long")
    derived = {
        "finish_count": items("finishes"), "has_etched_finish": holds("finishes", "etched"), "color_count": items("colors"), "color_identity_count": items("color_identity"),
        "variation_count": items("variations"), "is_legendary": holds("original_supertypes", "Legendary"),
    }
    own = {c: capped(F.col(c)) if c == "mana_value" else F.col(c) for c in CARD_COLUMNS} | derived | {c: F.col(c) for c in LEGALITY_COLUMNS} | {"print_count": prints}
    return rows.select(*[c.alias(n) for n, c in own.items()])


def language_premiums(variants: DataFrame, prices: DataFrame) -> DataFrame:
    """Each language variant's prices beside the canonical ones of its day, and their ratios; no row without a canonical row that day."""
    base = prices.select(F.col("uuid").alias("canonical_uuid"), "snapshot_date", F.col("eur").alias("canonical_eur"), F.col("eur_foil").alias("canonical_eur_foil"))
    rows = variants.select("scryfall_id", "canonical_uuid", "lang", "snapshot_date", *[F.col(c).alias(f"lang_{c}") for c in ("eur", "eur_foil", "usd", "usd_foil")]).join(base, ["canonical_uuid", "snapshot_date"])
    rows = rows.withColumns({f"{c}_lang_premium": ratio(F.col(f"lang_{c}"), F.col(f"canonical_{c}")) for c in ("eur", "eur_foil")})
    return rows.select("scryfall_id", "canonical_uuid", "lang", "snapshot_date", "lang_eur", "lang_eur_foil", "lang_usd", "lang_usd_foil", "canonical_eur", "canonical_eur_foil", "eur_lang_premium", "eur_foil_lang_premium")


# ---------------------------------------------------------------- legality


def _statuses(meta: DataFrame) -> DataFrame:
    """meta (id, snapshot_date, legalities: a map or JSON text, edhrec_rank) with each format's status and the one of the row before."""
    w = history("id")
    of = (lambda f: F.get_json_object("legalities", f"$.{f}")) if dict(meta.dtypes)["legalities"] == "string" else (lambda f: F.col("legalities")[f])
    rows = meta.withColumns({f"curr_{f}": of(f) for f in FORMATS})
    return rows.withColumns({f"prev_{f}": F.lag(f"curr_{f}").over(w) for f in FORMATS} | {"prev_rank": F.lag("edhrec_rank").over(w)})


def _turned(f: str, before: str, after: str) -> Column:
    return F.coalesce((F.col(f"prev_{f}") == before) & (F.col(f"curr_{f}") == after), F.lit(False))


def demand_signals(meta: DataFrame) -> DataFrame:
    """By id and day: rank and its change, the status in five formats, and whether it was banned or unbanned since the row before."""
    flags = [_turned(f, a, b).alias(f"{f}_{name}") for f in FORMATS for name, a, b in (("banned", "legal", "banned"), ("unbanned", "banned", "legal"))]
    change = (F.col("edhrec_rank") - F.col("prev_rank")).alias("edhrec_rank_change")
    return _statuses(meta).select("id", "snapshot_date", "edhrec_rank", change, *[F.col(f"curr_{f}").alias(f"{f}_legality") for f in FORMATS], *flags)


def transitions(meta: DataFrame) -> DataFrame:
    """(id, event_date, format, event_type): one window, then the formats side by side become rows."""
    kinds = [F.struct(F.lit(f).alias("format"), F.when(_turned(f, "legal", "banned"), "ban").when(_turned(f, "banned", "legal"), "unban").alias("event_type")) for f in FORMATS]
    rows = _statuses(meta).select("id", F.col("snapshot_date").alias("event_date"), F.inline(F.array(*kinds)))
    return rows.where("event_type IS NOT NULL")


def events(meta: DataFrame) -> DataFrame:
    return transitions(meta).groupBy("event_date", "format", "event_type").agg(F.count(F.lit(1)).alias("card_count"))


def ban_price_impact(meta: DataFrame, prices: DataFrame | None) -> DataFrame:
    """Mean prices by days from each transition, in one conditional aggregation; a transition without prices keeps its row."""
    keys = ["scryfall_id", "format", "event_type", "event_date"]
    changes = transitions(meta).withColumnRenamed("id", "scryfall_id").select(*keys)
    if prices is None:
        prices = meta.sparkSession.createDataFrame([], "scryfall_id string, snapshot_date date, eur double")
    rows = changes.join(prices.select("scryfall_id", "snapshot_date", "eur"), "scryfall_id", "left").withColumn("k", F.datediff("snapshot_date", "event_date"))
    spans = {"price_30d_before": (-30, -1), "price_7d_before": (-7, -1), "price_at_event": (0, 0), "price_7d_after": (1, 7), "price_30d_after": (1, 30)}
    means = rows.groupBy(*keys).agg(*[F.avg(F.when(F.col("k").between(*s), F.col("eur"))).alias(n) for n, s in spans.items()])
    return means.withColumns({f"price_change_{n}_pct": ratio(F.col(f"price_{n}_after") - F.col(f"price_{n}_before"), F.col(f"price_{n}_before")) for n in ("7d", "30d")})


# ---------------------------------------------------------------- staples and tournaments


def format_staples(staples: DataFrame) -> DataFrame:
    w = history("id")
    means = {f"deck_pct_{n}d_avg": F.avg("deck_pct").over(last(n, "id")) for n in (7, 30)}
    changes = {f"deck_pct_change_{n}d": F.col("deck_pct") - F.lag("deck_pct", n).over(w) for n in (7, 30)}
    rows = with_columns(staples, {"card_name": "string", "format": "string", "played": "double", "top": "int"})
    return rows.select("id", "card_name", "format", "snapshot_date", "deck_pct", "played", "top").withColumns(means | changes)


def tournament_signals(results: DataFrame, as_of: str) -> DataFrame:
    """By oracle id and format: distinct tournaments by recency and board, mean copies, share of the main deck, last date.

    First a row for each tournament, then one for each group: the distinct counts need no copy of the rows for each of them, as
    count(distinct ...) would.
    """
    age = F.datediff(F.to_date(F.lit(as_of)), F.to_date("tournament_date"))
    main = ~F.col("is_sideboard")
    any_ = lambda c: F.max(F.when(c, 1).otherwise(0))
    rows = results.where("oracle_id IS NOT NULL").withColumn("age", age)
    each = rows.groupBy("oracle_id", "format", "tournament_id").agg(
        F.min("scryfall_id").alias("scryfall_id"), any_(main & (F.col("age") <= 30)).alias("m30"), any_(main & (F.col("age") <= 90)).alias("m90"), any_(~main & (F.col("age") <= 30)).alias("s30"), any_(F.col("age") <= 90).alias("a90"),
        F.sum(F.when(main, F.col("copies").cast("double"))).alias("copies"), F.count(F.when(main, F.col("copies"))).alias("n"), F.max(F.when(main, F.to_date("tournament_date"))).alias("last"),
    )
    named = F.col("tournament_id").isNotNull().cast("int")  # a tournament without an id counts for nothing, its rows do
    total = lambda c: F.sum(F.col(c) * named)
    return each.groupBy("oracle_id", "format").agg(
        F.min("scryfall_id").alias("scryfall_id"), total("m30").alias("top8_appearances_30d"), total("m90").alias("top8_appearances_90d"), ratio(F.sum("copies"), F.sum("n")).alias("top8_copies_avg"),
        total("s30").alias("sideboard_appearances_30d"), (total("m90") * 100.0 / F.nullif(total("a90"), F.lit(0))).alias("main_deck_pct"), F.max("last").alias("last_top8_date"),
    ).select("oracle_id", "scryfall_id", "format", "top8_appearances_30d", "top8_appearances_90d", "top8_copies_avg", "sideboard_appearances_30d", "main_deck_pct", "last_top8_date")


# ---------------------------------------------------------------- the training frame

JOINED_CARD = {
    "rarity": "string", "mana_value": "double", "is_reserved": "boolean", "is_reprint": "boolean", "color_count": "int", "color_identity_count": "int", "is_commander_legal": "boolean", "is_modern_legal": "boolean",
    "is_legacy_legal": "boolean", "is_standard_legal": "boolean", "format_count": "int", "print_count": "long", "finish_count": "int", "has_etched_finish": "boolean", "edhrec_saltiness": "double", "set_type": "string",
}
JOINED_DEMAND = dict.fromkeys(("commander_banned", "modern_banned", "legacy_banned", "standard_banned", "commander_unbanned", "modern_unbanned"), "boolean") | {"edhrec_rank_change": "double"}
JOINED_TOURNAMENTS = {"top8_30d_total": "long", "top8_90d_total": "long", "top8_copies_avg": "double"}
#: Of each format the figures that are joined, and their names.
JOINED_STAPLES = {"staple_pct_commander": ("commander", "deck_pct"), "staple_7d_commander": ("commander", "deck_pct_7d_avg"), "staple_pct_modern": ("modern", "deck_pct"), "staple_pct_legacy": ("legacy", "deck_pct"), "staple_pct_vintage": ("vintage", "deck_pct"), "staple_7d_vintage": ("vintage", "deck_pct_7d_avg")}


def ml_dataset(prices: DataFrame, cards: DataFrame | None = None, demand: DataFrame | None = None, tournaments: DataFrame | None = None, staples: DataFrame | None = None) -> DataFrame:
    """Priced rows with the exact-date prices 7 and 30 days on, the label, and the columns of the other tables, null where a table is
    missing. Tournaments and staples need the cards, for oracle id and name."""
    rows = prices.where("eur IS NOT NULL")
    if "scryfall_id" not in rows.columns:
        rows = rows.withColumn("scryfall_id", F.lit(None).cast("string"))
    for n in (7, 30):
        ahead = prices.select("uuid", F.date_sub("snapshot_date", n).alias("snapshot_date"), F.col("eur").alias(f"target_price_{n}d"))
        rows = rows.join(ahead, ["uuid", "snapshot_date"], "left")
    rows = rows.withColumn("target_change_30d", direction(F.col("eur"), F.col("target_price_30d")))
    spine = list(rows.columns)
    if cards is not None:
        own = with_columns(cards, {"oracle_id": "string", "name": "string"} | JOINED_CARD)
        rows = rows.drop(*JOINED_CARD).join(own.select("uuid", F.col("oracle_id").alias("__oracle"), F.col("name").alias("__name"), *JOINED_CARD), "uuid", "left")
    if demand is not None:
        rows = rows.drop(*JOINED_DEMAND).join(with_columns(demand, JOINED_DEMAND).select(F.col("id").alias("scryfall_id"), "snapshot_date", *JOINED_DEMAND), ["scryfall_id", "snapshot_date"], "left")
    if tournaments is not None and cards is not None:
        own = tournaments.groupBy(F.col("oracle_id").alias("__oracle")).agg(F.sum("top8_appearances_30d").alias("top8_30d_total"), F.sum("top8_appearances_90d").alias("top8_90d_total"), F.avg("top8_copies_avg").alias("top8_copies_avg"))
        rows = rows.join(own, "__oracle", "left")
    if staples is not None and cards is not None:
        # a name has a row a day and format, so one pass gives what a join for each format would
        wide = staples.groupBy(F.col("card_name").alias("__name"), "snapshot_date").agg(*[F.max(F.when(F.col("format") == f, F.col(c))).alias(n) for n, (f, c) in JOINED_STAPLES.items()])
        rows = rows.join(wide, ["__name", "snapshot_date"], "left")
    joined = JOINED_CARD | JOINED_DEMAND | JOINED_TOURNAMENTS | dict.fromkeys(JOINED_STAPLES, "double")
    return with_columns(rows, joined).select(*[c for c in spine if c not in joined], *joined)
