"""Preference formatting of conversation pairs. DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (same role and text at the same place) is
rendered once as the prompt; what follows in either is rendered as its completion, with the spans of the assistant's texts, the only
ones that are trained on. Places count from 1 in the order of turn (nulls last), role and text.

Null roles are `unknown`, null texts empty. Pairs of equal conversations have empty completions. A conversation without partner has
a null id on the other side, no prompt and only its own completion. Repeated rows are turns of their own. Conversations with a null
id are left out. An empty table gives no rows. One shuffle by pair; only a pair's own turns meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import table

HEAD, MIDDLE, TAIL = "<|", "|>\n", "\n<|end|>\n"


def format_pairs(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (0 chosen, 1 rejected), conv_id, turn, role, text. One row a pair."""
    rows = turns.select("pair_id", "side", "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("pair_id")
    at = F.row_number().over(W.Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_last(), "role", "text"))
    rows = rows.withColumn("place", at)
    here = W.Window.partitionBy("pair_id", "place")
    said = F.struct("role", "text")
    alike = (F.count(F.lit(1)).over(here) == 2) & (F.min(said).over(here) == F.max(said).over(here))
    rows = rows.withColumn("alike", alike)
    rows = rows.withColumn("differs", F.min(F.when(~F.col("alike"), F.col("place"))).over(W.Window.partitionBy("pair_id")))
    rows = rows.withColumn("shared", F.coalesce(F.col("place") < F.col("differs"), F.lit(True)))
    head = F.concat(F.lit(HEAD), "role", F.lit(MIDDLE))
    rows = rows.withColumn("rendered", F.concat(head, "text", F.lit(TAIL)))
    before = F.sum(F.length("rendered")).over(W.Window.partitionBy("pair_id", "side", "shared").orderBy("place").rowsBetween(W.Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.length(head)
    rows = rows.withColumn("span", F.when(F.col("role") == "assistant", F.concat(start.cast("string"), F.lit(":"), F.length("text").cast("string"))))

    def joined(what: str, side: int, shared: bool, separator: str):
        kept = F.when((F.col("side") == side) & (F.col("shared") == shared) & F.col(what).isNotNull(), F.struct("place", what))
        return F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x[what]), separator)

    return rows.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == 0, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(F.col("side") == 1, F.col("conv_id"))).alias("rejected_id"),
        F.count(F.when((F.col("side") == 0) & F.col("shared"), 1)).alias("prompt_turns"),
        joined("rendered", 0, True, "").alias("prompt"), joined("rendered", 0, False, "").alias("chosen"), joined("rendered", 1, False, "").alias("rejected"),
        joined("span", 0, False, ",").alias("chosen_spans"), joined("span", 1, False, ",").alias("rejected_spans"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """The conversations 2n (chosen) and 2n + 1 (rejected) as pair n."""
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.pmod("conv_id", F.lit(2)).cast("int").alias("side"), "conv_id", "turn", "role", "text")


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(neighbours(table(spark, sf_dir, "conversations")))


ORACLE = r"""
WITH t AS (
  SELECT (conv_id // 2)::BIGINT AS pair_id, conv_id % 2 AS side, conv_id, COALESCE(role, 'unknown') AS role, COALESCE(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS LAST, COALESCE(role, 'unknown'), COALESCE(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (
  SELECT *, COUNT(*) OVER p = 2 AND MIN(role) OVER p = MAX(role) OVER p AND MIN(text) OVER p = MAX(text) OVER p AS alike
  FROM t WINDOW p AS (PARTITION BY pair_id, place)),
s AS (SELECT *, COALESCE(place < MIN(place) FILTER (NOT alike) OVER (PARTITION BY pair_id), true) AS shared,
  '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS rendered FROM a),
r AS (SELECT *, CASE WHEN role = 'assistant' THEN
    (COALESCE(SUM(length(rendered)) OVER (PARTITION BY pair_id, side, shared ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head))::BIGINT::VARCHAR || ':' || length(text)::VARCHAR END AS span FROM s)
SELECT pair_id, MAX(conv_id) FILTER (side = 0) AS chosen_id, MAX(conv_id) FILTER (side = 1) AS rejected_id,
  COUNT(*) FILTER (side = 0 AND shared) AS prompt_turns,
  COALESCE(string_agg(rendered, '' ORDER BY place) FILTER (side = 0 AND shared), '') AS prompt,
  COALESCE(string_agg(rendered, '' ORDER BY place) FILTER (side = 0 AND NOT shared), '') AS chosen,
  COALESCE(string_agg(rendered, '' ORDER BY place) FILTER (side = 1 AND NOT shared), '') AS rejected,
  COALESCE(string_agg(span, ',' ORDER BY place) FILTER (side = 0 AND NOT shared), '') AS chosen_spans,
  COALESCE(string_agg(span, ',' ORDER BY place) FILTER (side = 1 AND NOT shared), '') AS rejected_spans
FROM r GROUP BY pair_id
"""
