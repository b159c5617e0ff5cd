"""Cleaned tier: the merged catalogue, the day's prices, language prices, appended histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.expr import LANGUAGES, capitalised, cleaned, flag, json_list, lookup, subtypes, type_parts

# ---------------------------------------------------------------- steps


def drop_flagged(rows: DataFrame, flags: list[str]) -> DataFrame:
    for f in flags:
        rows = rows.where(~flag(F.col(f)))
    return rows


def exclude_ids(rows: DataFrame, key: str | Column, ids: DataFrame) -> DataFrame:
    """SQL's NOT IN without its null-aware broadcast join: with any excluded id a null key goes, with a null among the excluded ids
    all rows go, without any all rows stay. One look at the ids decides which; then a plain anti join does it."""
    name = ids.columns[0]
    n, known = ids.agg(F.count(F.lit(1)), F.count(name)).first()
    if not n:
        return rows
    if known < n:
        return rows.where(F.lit(False))
    value = F.col(key) if isinstance(key, str) else key
    marked = rows.withColumn("__key", value).where("__key IS NOT NULL")
    return marked.join(ids.select(F.col(name).alias("__key")).distinct(), "__key", "left_anti").select(*rows.columns)


def merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join by the trimmed key; of common columns the left value comes first. has_left says which rows the left has."""
    l, r = left.withColumn("__k", F.trim(key)), right.withColumn("__k", F.trim(key))
    l, r = l.withColumn("__l", F.lit(True)).alias("l"), r.alias("r")
    columns = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c != key]
    pick = lambda c: F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")) if c in left.columns and c in right.columns else F.col(f"{'l' if c in left.columns else 'r'}.{c}")
    joined = l.join(r, F.col("l.__k") == F.col("r.__k"), "full_outer")
    return joined.select(F.coalesce("l.__k", "r.__k").alias(key), *[pick(c).alias(c) for c in columns], F.coalesce("l.__l", F.lit(False)).alias("has_left"))


def canonical_ids(rows: DataFrame, keys: list[str], uuid: str = "uuid", known: DataFrame | None = None) -> DataFrame:
    """canonical_uuid: the row's own uuid, else the least of `known` (or of rows) with the same keys."""
    known = rows if known is None else known
    least = known.where(F.col(uuid).isNotNull()).groupBy(*keys).agg(F.min(uuid).alias("__least"))
    return rows.join(least, keys, "left").withColumn("canonical_uuid", F.coalesce(F.col(uuid), F.col("__least"))).drop("__least").select(*rows.columns, "canonical_uuid")


def one_per_key(rows: DataFrame, key: str, uuid: str = "uuid") -> DataFrame:
    """Null keys go; of a key's rows the one with the smallest uuid stays, one without only if there is no other."""
    w = W.Window.partitionBy(key).orderBy(F.col(uuid).asc_nulls_last())
    return rows.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pivot_points(points: DataFrame, keys: list[str], combos: dict[str, tuple[str, str, str]]) -> DataFrame:
    """EAV price points (retailer, tx_type, finish, price) as one column for each combination."""
    where = lambda r, t, f: (F.col("retailer") == r) & (F.col("tx_type") == t) & (F.col("finish") == f)
    return points.groupBy(*keys).agg(*[F.max(F.when(where(*c), F.col("price"))).alias(n) for n, c in combos.items()])


def forward_fill(today: DataFrame, past: DataFrame, key: str, values: list[str], date: str = "snapshot_date") -> DataFrame:
    """Rows of today without any value take all values of the key's latest strictly earlier row of past, even if those are null.

    Today's and past rows meet in one window by key and date, so the cost doesn't grow with the number of dates asked for. Past rows
    of one key and date count as one, with the greatest of each value.
    """
    n = "__" + "_" * max(map(len, today.columns))  # of no column
    before = past.where(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(key, date).agg(F.struct(*[F.max(c).alias(c) for c in values]).alias(f"{n}v"))
    asked = today.withColumn(f"{n}v", F.lit(None).cast(before.schema[f"{n}v"].dataType))
    earlier = W.Window.partitionBy(key).orderBy(date).rangeBetween(W.Window.unboundedPreceding, -1)
    both = asked.withColumn(f"{n}row", F.struct(*today.columns)).select(key, date, f"{n}v", f"{n}row").unionByName(before, allowMissingColumns=True)
    both = both.withColumn(f"{n}d", F.datediff(date, F.lit("1970-01-01")))
    earlier = W.Window.partitionBy(key).orderBy(f"{n}d").rangeBetween(W.Window.unboundedPreceding, -1)
    found = both.withColumn(f"{n}last", F.last(f"{n}v", ignorenulls=True).over(earlier)).where(F.col(f"{n}row").isNotNull())
    row = lambda c: F.col(f"{n}row")[c]
    empty = F.coalesce(*[row(c).cast("string") for c in values]).isNull() & F.col(f"{n}last").isNotNull()
    return found.select(*[(F.when(empty, F.col(f"{n}last")[c]).otherwise(row(c)) if c in values else row(c)).alias(c) for c in today.columns])


def append_new(history: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows whose keys the history lacks; null keys never match, and the batch isn't deduplicated in itself."""
    return batch.join(history.select(*keys).distinct(), keys, "left_anti")


# ---------------------------------------------------------------- the merged catalogue

_plain = F.trim
_lower = lambda c: F.lower(F.trim(c))
_upper = lambda c: F.upper(F.trim(c))
_unset = cleaned
_unset_upper = lambda c: F.nullif(_upper(c), F.lit("_"))
_unset_lower = lambda c: F.nullif(_lower(c), F.lit("_"))
_number = lambda c: c.cast("string").try_cast("double")
_list = json_list
_list_upper = lambda c: json_list(c, F.upper)
_list_lower = lambda c: json_list(c, F.lower)
_list_capitalised = lambda c: json_list(c, capitalised)
_kept = lambda c: c

#: Of each feed: a column's cleaning, by the names that the column has afterwards. Which column is cleaned how.
CARD_RULES: dict[Callable[[Column], Column], str] = {
    _plain: "uuid name frame_version",
    _lower: "layout rarity border_color side",
    _upper: "set_code",
    _unset: "collector_number text original_text power toughness loyalty defense flavor_text flavor_name artist printed_name printed_text face_name",
    _unset_upper: "mana_cost",
    _unset_lower: "watermark security_stamp",
    _number: "mana_value face_mana_value edhrec_rank edhrec_saltiness",
    flag: "is_reprint is_reserved is_promo is_full_art is_textless is_alternative is_story_spotlight is_timeshifted is_rebalanced is_game_changer has_alternative_deck_limit has_content_warning",
    _kept: "legalities",
    _list_upper: "colors color_identity color_indicator produced_mana printings",
    _list_capitalised: "keywords",
    _list_lower: "finishes availability frame_effects booster_types promo_types",
    _list: "rulings artist_ids other_face_ids card_parts variations",
}
PRINT_RULES: dict[Callable[[Column], Column], str] = {
    _plain: "oracle_id name type_line illustration_id collector_number frame_version set_id set_name scryfall_uri lang",
    _lower: "layout border_color rarity set_type",
    _upper: "set_code",
    _unset: "text power toughness loyalty defense artist flavor_name flavor_text printed_name printed_text printed_type_line",
    _unset_upper: "mana_cost",
    _unset_lower: "security_stamp watermark",
    _number: "mana_value tcgplayer_id cardmarket_id penny_rank",
    flag: "is_reserved is_reprint is_promo is_full_art is_textless is_variation is_booster is_story_spotlight game_changer",
    _kept: "legalities",
    _list_upper: "color_identity color_indicator colors produced_mana",
    _list_capitalised: "keywords",
    _list_lower: "finishes frame_effects games promo_types",
    _list: "artist_ids multiverse_ids all_parts card_faces",
}
#: Names that a feed has for a column, where they differ.
CARD_NAMES = {"collector_number": "number"}
PRINT_NAMES = {
    "mana_value": "cmc", "text": "oracle_text", "frame_version": "frame", "set_code": "set", "is_reserved": "reserved", "is_reprint": "reprint", "is_promo": "promo", "is_full_art": "full_art",
    "is_textless": "textless", "is_variation": "variation", "is_booster": "booster", "is_story_spotlight": "story_spotlight",
}
#: Super- and card types that are told apart in a type line; sets and layouts that are left out; legality columns, and the formats that are counted: fixed values.
SUPERTYPES = ["Legendary", "Basic", "Snow", "World", "Elite", "Host"]
TYPES = ["Creature", "Instant", "Sorcery", "Artifact", "Enchantment", "Planeswalker", "Land", "Battle", "Tribal", "Conspiracy", "Dungeon"]
LEFT_OUT_SETS, LEFT_OUT_LAYOUTS = ["funny", "memorabilia"], ["token", "double_faced_token", "emblem"]
LEGAL_FORMATS = ["commander", "standard", "modern", "legacy"]
COUNTED_FORMATS = [
    "standard", "pioneer", "modern", "legacy", "vintage", "commander", "oathbreaker", "brawl", "historicbrawl", "alchemy",
    "explorer", "historic", "timeless", "gladiator", "penny", "paupercommander", "pauper", "predh", "premodern", "oldschool",
]


def _clean(rows: DataFrame, rules: dict[Callable, str], names: dict[str, str]) -> dict[str, Column]:
    """The cleaned columns; one that the feed lacks is null before its rule."""
    source = lambda n: F.col(names.get(n, n)) if names.get(n, n) in rows.columns else F.lit(None).cast("string")
    return {n: rule(source(n)) for rule, own in rules.items() for n in own.split()}


def left_out_ids(prints: DataFrame) -> DataFrame:
    return prints.where(F.coalesce(F.lower(F.trim("set_type")), F.lit("")).isin(LEFT_OUT_SETS)).select(F.trim("id").alias("id"))


def clean_cards(cards: DataFrame, left_out: DataFrame) -> DataFrame:
    """The left feed: paper cards that aren't left out, by scryfall_id."""
    rows = drop_flagged(cards, [c for c in ("is_online_only", "is_funny", "is_oversized") if c in cards.columns])
    key = F.trim(F.get_json_object("identifiers", "$.scryfall_id"))
    rows = exclude_ids(rows, key, left_out)
    line, text = F.trim(F.coalesce(F.col("original_type") if "original_type" in rows.columns else F.lit(None).cast("string"), F.lit(""))), _clean(rows, {_plain: "text original_text ascii_name"}, {})
    own = _clean(rows, CARD_RULES, CARD_NAMES)
    own |= {
        "scryfall_id": key, "ascii_name": F.coalesce(text["ascii_name"], own["name"]), "language": capitalised(F.trim("language")),
        "errata": text["original_text"].isNotNull() & (F.coalesce(text["text"], F.lit("")) != text["original_text"]),
        "original_supertypes": type_parts(line, SUPERTYPES), "original_types": type_parts(line, TYPES), "original_subtypes": subtypes(line),
    }
    return rows.select(*[c.alias(n) for n, c in own.items()])


def clean_prints(prints: DataFrame, left_out: DataFrame) -> DataFrame:
    """The right feed: printings on paper that aren't left out, by scryfall_id."""
    rows = drop_flagged(prints, [c for c in ("digital", "oversized") if c in prints.columns])
    rows = exclude_ids(rows.where(~F.coalesce("layout", F.lit("")).isin(LEFT_OUT_LAYOUTS)), F.trim("id"), left_out)
    own = _clean(rows, PRINT_RULES, PRINT_NAMES)
    own |= {"scryfall_id": F.trim("id"), "ascii_name": own["name"], "language": lookup(own["lang"], LANGUAGES)}
    return rows.select(*[c.alias(n) for n, c in own.items()])


def legal(format_: str) -> Column:
    return F.lower(F.get_json_object("legalities", f"$.{format_}")) == "legal"


def cards(cards: DataFrame, prints: DataFrame) -> DataFrame:
    """The merged catalogue, one row a scryfall_id: both feeds cleaned and joined in full, the left one's values first; the canonical
    uuid of printings in other languages; of a card's faces the first; four legality flags and the number of formats where it is legal.
    """
    left_out = left_out_ids(prints)
    left, right = clean_cards(cards, left_out), clean_prints(prints, left_out)
    joined = merge(left, right, "scryfall_id").drop("has_left")
    known = left.where("set_code IS NOT NULL AND collector_number IS NOT NULL").select("set_code", "collector_number", "uuid")
    rows = one_per_key(canonical_ids(joined, ["set_code", "collector_number"], known=known), "scryfall_id")
    counted = sum((F.coalesce(legal(f).cast("int"), F.lit(0)) for f in COUNTED_FORMATS), F.lit(0))
    return rows.withColumns({f"is_{f}_legal": legal(f) for f in LEGAL_FORMATS} | {"format_count": counted})


# ---------------------------------------------------------------- the day's prices

SCALAR_PRICES = ["eur", "eur_foil", "usd", "usd_foil"]
#: Columns of the pivoted price points: (retailer, tx_type, finish). Fixed values.
POINT_PRICES = {
    "cardmarket_eur": ("cardmarket", "retail", "normal"),
    "cardmarket_eur_foil": ("cardmarket", "retail", "foil"),
    "cardmarket_buylist_eur": ("cardmarket", "buylist", "normal"),
    "tcgplayer_usd": ("tcgplayer", "retail", "normal"),
    "tcgplayer_usd_foil": ("tcgplayer", "retail", "foil"),
    "tcgplayer_buylist_usd": ("tcgplayer", "buylist", "normal"),
    "cardkingdom_usd": ("cardkingdom", "retail", "normal"),
    "cardkingdom_usd_foil": ("cardkingdom", "retail", "foil"),
    "cardkingdom_buylist_usd": ("cardkingdom", "buylist", "normal"),
    "cardkingdom_buylist_usd_foil": ("cardkingdom", "buylist", "foil"),
    "manapool_usd": ("manapool", "retail", "normal"),
    "manapool_usd_foil": ("manapool", "retail", "foil"),
}


def _on(rows: DataFrame, day: str) -> DataFrame:
    return rows.where(F.col("snapshot_date") == F.to_date(F.lit(day)))


def _scalar(prices: DataFrame, day: str) -> DataFrame:
    return _on(prices, day).select(F.col("id").alias("scryfall_id"), "snapshot_date", *SCALAR_PRICES)


def prices(merged: DataFrame, scalar: DataFrame, points: DataFrame | None, history: DataFrame | None, day: str) -> DataFrame:
    """A day's 16 prices of each card with a uuid: its own, or as an English printing the canonical one. Without price points their
    columns are null; rows without any price take those of the latest earlier day, if there is a history."""
    known = merged.where("scryfall_id IS NOT NULL AND (uuid IS NOT NULL OR language = 'English')").select("scryfall_id", F.coalesce("uuid", "canonical_uuid").alias("uuid")).where("uuid IS NOT NULL")
    rows = _scalar(scalar, day).join(known, "scryfall_id")
    if points is None:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in POINT_PRICES})
    else:
        rows = rows.join(pivot_points(_on(points, day), ["uuid", "snapshot_date"], POINT_PRICES), ["uuid", "snapshot_date"], "left")
    rows = rows.select("uuid", "scryfall_id", "snapshot_date", *SCALAR_PRICES, *POINT_PRICES)
    return rows if history is None else forward_fill(rows, history, "scryfall_id", [*SCALAR_PRICES, *POINT_PRICES])


def language_prices(merged: DataFrame, prints: DataFrame, scalar: DataFrame, history: DataFrame | None, day: str) -> DataFrame:
    """A day's prices of the printings in other languages, which have a canonical uuid and none of their own."""
    variants = merged.where("uuid IS NULL AND canonical_uuid IS NOT NULL AND scryfall_id IS NOT NULL").select("scryfall_id", "canonical_uuid")
    variants = variants.join(prints.select(F.trim("id").alias("scryfall_id"), "lang"), "scryfall_id", "left")
    rows = _scalar(scalar, day).join(variants, "scryfall_id").select("scryfall_id", "canonical_uuid", "lang", "snapshot_date", *SCALAR_PRICES)
    return rows if history is None else forward_fill(rows, history, "scryfall_id", SCALAR_PRICES)
