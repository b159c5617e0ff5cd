"""The corpus pipeline: language identification, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows as Parquet to the
shared folder and reads them again as the next one's docs. All stages but the last return docs' columns, with docs' values, whatever
the names of extra columns; an empty table passes all stages; very long texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from snapforge.llm import jaccard_join, language_id, mixing, packing
from snapforge.llm.common import discard, materialise, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is recognised; those that the models reject go.

    Null, empty and letter-less texts go, as they have no language. Repeated rows stay or go alike. Of languages that score the same
    the first counts, which decides nothing here. Without a labelled text to learn from nothing is recognised and all rows go. Null
    ids, languages and sources are no hindrance.
    """
    models = language_id.train(language_id.sample(docs.where(~language_id.held_out())))
    # by position, so that no column of docs has the name of one that the models add
    apart = docs.toDF(*[f"__{i}" for i in range(len(docs.columns))])
    rows = language_id.predict(apart, models, text_col=f"__{docs.columns.index('text')}").where("NOT rejected")
    return rows.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    Null, empty and white-space texts are no near duplicates and stay, as do all rows without an id. Rows that share an id are one
    document: of them the one of the first text by code points stays (null last), and of equal texts the first by its other columns
    as text, so a repeated row stays once.
    """
    found = materialise(jaccard_join.jaccard_components(docs.select("doc_id", "text")), "components")
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    if not found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        others = [F.to_json(F.struct(F.col(c).alias("v"))) for c in docs.columns if c not in ("doc_id", "text")]
        first = F.row_number().over(W.Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *others))
        name = "__nth" + "_" * max(map(len, docs.columns))
        out = out.withColumn(name, first).where(F.col(name) == 1).drop(name)
    return out.union(docs.where("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document may be there up to three times.

    Null sources are one source, the last. Null, empty and white-space texts have no words: they weigh nothing, and are taken as often
    as their place among their source's says. Rows of the same id, text and source tie and are taken alike, each for itself.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4,096 tokens.

    Null and empty texts are a piece of the end token alone. Repeated rows are packed as often as they come. Pieces of one length tie,
    and take their places by id, start and content. Extra columns aren't read.
    """
    return packing.pack_documents(docs)


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("mixing", mix), ("packing", pack)]

#: Language identification and tokens can't be expressed in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir).select(*[F.col(c) for c in docs.columns]), name)
        if last:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
