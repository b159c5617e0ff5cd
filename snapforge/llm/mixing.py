"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Each source's rows take a place by a 36-bit digest of (doc_id, text). Tokens are summed by source and by the first 12 bits of the
place; the first bucket in which the running sum passes the source's budget is refined by the next 12 bits, and once more. Rows
below the found threshold are taken once more than the others, so nothing is sorted, and a smaller budget takes a subset.

Sizes are numbers of words `[^\x20\x09-\x0D]+`; null and empty texts have size 0. A null source is a source of its own, the last in
order. Rows with equal id and text tie and are taken alike. Reruns agree, as nothing but the rows decides. Extra columns aren't
read by `mix_plan`. Very long texts count whole, and one that is larger than what a budget has left is passed over. An empty table
gives no rows; targets are then of no consequence. The sources, one row each, are ordered in one task, and their rules are joined to
all rows: that holds for some millions of sources, not for a source a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialise, table

WORDS = r"[^\x20\x09-\x0D]++"
MOST = 3
LEVELS = 3
REFILLS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """36 bits as nine hexadecimal digits."""
    return F.substring(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))), 1, 9)


def source_targets(sizes: DataFrame, weight: Column | None = None) -> DataFrame:
    """(source, source_size, target) from (source, size): one row for each source, the only thing that one task orders.

    With the sources ordered by the ratio of cap to weight, those before the first whose ratio exceeds the level at which the rest
    share what the caps leave are capped; the others get the level times their weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # one row for each source from here on
    nth = F.row_number().over(W.Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", (nth - 1) % 3 + 1 if weight is None else weight).withColumn("cap", F.col("source_size") * MOST)
    by = W.Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, W.Window.unboundedFollowing)
    everything = W.Window.partitionBy().rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    per = per.select(
        "source", "source_size", "weight", "cap", F.row_number().over(by).alias("nth"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left_over"),
        F.sum("weight").over(after).alias("weights"),
    )
    share = F.col("left_over") * F.col("weight") / F.col("weights")
    first_free = F.min(F.when(share <= F.col("cap"), F.struct("nth", "left_over", "weights"))).over(everything)
    per = per.withColumn("free", first_free)
    free = F.col("free")
    target = F.when(F.col("nth") < free["nth"], F.col("cap").cast("double")).otherwise(F.least(free["left_over"] * F.col("weight") / free["weights"], F.col("cap").cast("double")))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame, last: bool) -> DataFrame:
    """(of, threshold, took): for each source of budgets (of, budget) the place below which its rows (source, place, size) fit the
    budget, and their size. Only the bucket in which the budget runs out is looked at more closely. last: the final bucket is taken
    if that comes nearer."""
    state = budgets.select("of", "budget", F.lit(0).cast("long").alias("below"), F.lit("").alias("prefix"))
    for level in range(1, LEVELS + 1):
        at = 3 * level
        inside = rows.join(state, rows["source"].eqNullSafe(state["of"]) & (F.substring(rows["place"], 1, at - 3) == state["prefix"]))
        buckets = inside.groupBy("of", "budget", "below", F.substring("place", 1, at).alias("bucket")).agg(F.sum("size").alias("tokens"))
        upto = F.col("below") + F.sum("tokens").over(W.Window.partitionBy("of").orderBy("bucket"))  # 4,096 rows a source at most
        buckets = buckets.withColumn("upto", upto)
        over = F.col("upto") > F.col("budget")
        if last and level == LEVELS:
            over = F.col("upto") - F.col("budget") > F.col("budget") - (F.col("upto") - F.col("tokens"))
        found = buckets.groupBy(F.col("of").alias("__of")).agg(F.min(F.when(over, F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("below")))).alias("x"), F.max("upto").alias("all"))
        state = state.join(found, state["of"].eqNullSafe(F.col("__of")), "left").select(
            "of", "budget",
            F.coalesce("x.below", "all", "below").alias("below"),
            # no bucket crosses: z comes after all digits, so all rows in the prefix are below
            F.coalesce("x.bucket", F.when(F.col("prefix").endswith("z"), F.col("prefix")).otherwise(F.concat("prefix", F.lit("z")))).alias("prefix"),
        )
        state = materialise(state, "thresholds")
    return state.select("of", F.col("prefix").alias("threshold"), F.col("below").alias("took"))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, place, size, source, source_size, target, repeats) of every row: how often the mix takes it, 0 to 3 times.

    Where the row at a threshold is larger than what is left of the budget, REFILLS more passes spend that on the rows after it
    that are no larger; with many rows a source nothing is left to speak of.
    """
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), place(F.col(id_col), text).alias("place"))
    sized = materialise(sized, "sized")
    targets = source_targets(sized.select("source", "size"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    state = materialise(targets.select(F.col("source").alias("of"), "source_size", "target", "whole", "budget"), "targets")
    # rules: the thresholds and the budgets they were found for, in the order of the passes
    for n in range(REFILLS + 1):
        taken = F.lit(False)
        for m in range(n):
            taken = taken | ((F.col("size") <= F.col(f"budget{m}")) & (F.col("place") < F.col(f"threshold{m}")))
        rows = sized
        if n:
            keyed = state.withColumnRenamed("of", "__of")
            rows = sized.join(keyed, sized["source"].eqNullSafe(F.col("__of"))).where(~taken & (F.col("size") <= F.col("budget"))).select("source", "place", "size")
        found = _threshold(rows, state.select("of", "budget"), n == REFILLS).withColumnRenamed("of", "__of")
        limit = F.col("budget") if n else F.lit(float("inf"))
        state = state.join(found, state["of"].eqNullSafe(F.col("__of"))).drop("__of").withColumns({f"budget{n}": limit, "budget": F.col("budget") - F.col("took")})
        state = materialise(state.withColumnRenamed("threshold", f"threshold{n}").drop("took"), "rules")
    taken = F.lit(False)
    for m in range(REFILLS + 1):
        taken = taken | ((F.col("size") <= F.col(f"budget{m}")) & (F.col("place") < F.col(f"threshold{m}")))
    joined = sized.join(state, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "place", "size", "source", "source_size", "target", F.least(F.col("whole") + taken.cast("long"), F.lit(MOST).cast("long")).alias("repeats"))


def mix(docs: DataFrame) -> DataFrame:
    """docs with the rows that the mix takes, each as often as it takes them; all columns stay as they are, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), place(F.col("doc_id"), F.col("text")).alias("at"), F.col("source").alias("of"))
    plan = mix_plan(docs).where("repeats > 0").select(F.col("doc_id").alias("x"), F.col("place").alias("y"), F.col("source").alias("z"), "repeats").dropDuplicates(["x", "y", "z"])
    taken = rows.join(plan, F.col("id").eqNullSafe(F.col("x")) & (F.col("at") == F.col("y")) & F.col("of").eqNullSafe(F.col("z")))
    copies = taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("copy"))
    return copies.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


#: DuckDB, over a relation `docs` of documents' columns: the rows of `mix_plan`.
PLAN_SQL = r"""
sized AS (
  SELECT doc_id, source, text, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    left(md5(COALESCE(doc_id::VARCHAR, '-') || '|' || COALESCE(text, '')), 9) AS place FROM {docs}),
per AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM per),
ranked AS (
  SELECT *, row_number() OVER w AS nth,
    (SUM(source_size) OVER ())::BIGINT - COALESCE(SUM(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_over,
    (SUM(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
  FROM weighed WINDOW w AS (ORDER BY cap / weight ASC, source ASC NULLS LAST)),
free AS (SELECT nth AS f, left_over AS l, weights AS ws FROM ranked WHERE left_over::DOUBLE * weight / weights <= cap ORDER BY nth LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN f IS NULL OR nth < f THEN cap::DOUBLE ELSE LEAST(l::DOUBLE * weight / ws, cap::DOUBLE) END AS target FROM ranked LEFT JOIN free ON true),
wholes AS (SELECT *, CASE WHEN source_size > 0 THEN LEAST(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM targets),
p0 AS (
  SELECT s.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS b0,
    SUM(size) OVER (PARTITION BY s.source ORDER BY place RANGE UNBOUNDED PRECEDING) AS u0
  FROM sized s JOIN wholes t ON s.source IS NOT DISTINCT FROM t.source),
p1 AS (SELECT *, b0 - COALESCE(MAX(u0) FILTER (u0 <= b0) OVER (PARTITION BY source), 0) AS b1, u0 <= b0 AS k0 FROM p0),
q1 AS (SELECT *, (NOT k0 AND size <= b1) AS e1, SUM(size) FILTER (NOT k0 AND size <= b1) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS u1 FROM p1),
p2 AS (SELECT *, b1 - COALESCE(MAX(u1) FILTER (e1 AND u1 <= b1) OVER (PARTITION BY source), 0) AS b2, e1 AND u1 <= b1 AS k1 FROM q1),
q2 AS (
  SELECT *, (NOT k0 AND NOT k1 AND size <= b2) AS e2,
    SUM(size) FILTER (NOT k0 AND NOT k1 AND size <= b2) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS u2,
    SUM(size) FILTER (NOT k0 AND NOT k1 AND size <= b2) OVER (PARTITION BY source, place) AS t2 FROM p2),
plan AS (SELECT *, whole + CASE WHEN k0 OR k1 OR (e2 AND (u2 - b2 <= b2 - (u2 - t2))) THEN 1 ELSE 0 END AS repeats FROM q2)
"""
ORACLE = "WITH " + PLAN_SQL.replace("{docs}", "documents") + " SELECT doc_id, size, source_size, target, (repeats * size)::BIGINT AS taken FROM plan"
