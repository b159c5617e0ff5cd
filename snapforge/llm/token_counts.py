"""Token counts through a digest cache.

A text's key is the digest of its normalised content beside the digest of the tokenizer's file. Keys are joined to the stored
counts; only the distinct keys without one are encoded, and their counts are appended to the cache, a Parquet folder.

Null texts count as empty. Equal texts are encoded once, repeated rows of one id too. Very long texts are encoded whole. Columns besides `id_col` and `text_col` are not read, so clashing names
don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, frugal, slices, table

#: Texts of these characters only are split alike by both libraries; all others go to `tokenizers`.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*\Z")
_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def counter(name: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens. Where a rank file of the same vocabulary lies beside a byte-level .json
    file, plain texts take that faster encoder; both give the same ids (tests/llm hold one against the other)."""
    if name in _LOADED:
        return _LOADED[name]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    else:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        fast, ranks = None, path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            table_ = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks, "rb"))}
            special = {t.content: i for i, t in slow.get_added_tokens_decoder().items() if t.special}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens=special)

        def count(texts: list[str]) -> list[int]:
            out = [-1] * len(texts)
            if fast:
                for i, x in enumerate(texts):
                    if _PLAIN.match(x):
                        out[i] = len(fast.encode(x, allowed_special="all"))
            rest = [i for i, x in enumerate(out) if x < 0]
            for i in rest:
                out[i] = len(slow.encode(texts[i], add_special_tokens=False).ids)
            return out

    _LOADED[name] = count
    return count


def tokenizer_digest(name: str) -> str:
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def same(text: Column) -> Column:
    """The normalisation of byte-level tokenizers: none, as white space and case change their counts."""
    return text


def count_tokens(docs: DataFrame, cache: str, *, tokenizer: str, normalise: Callable[[Column], Column] = same, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of docs, in the cache folder `cache`, which is made if it's missing.

    The misses' texts cross the network once, to their own key's and row's place, so a hot text is no hot partition.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.sha2("text", 256))
    kept = T.StructType([T.StructField("version", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("n_tokens", T.LongType())])
    stored = _stored(spark, cache, kept).where(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    first = keyed.groupBy("digest").agg(F.min_by("doc_id", "doc_id").alias("rep"), F.count("doc_id").alias("with_id"), (F.count(F.lit(1)) > 1).alias("several")).join(stored, "digest", "left_anti")
    first = first.select(F.col("digest").alias("own"), F.when(F.col("with_id") > 0, F.col("rep")).alias("rep"), "several")
    # null ids: a digest that only rows without an id have is matched null-safely
    misses = keyed.join(first.hint("shuffle_hash"), (keyed["digest"] == first["own"]) & keyed["doc_id"].eqNullSafe(first["rep"]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        seen: set[str] = set()  # repeated rows of one id and text lie in one task
        for batch in batches:
            for part in slices(batch, "text"):
                several = np.asarray(part.column("several"))
                if several.any():
                    fresh = ~several
                    for i in np.flatnonzero(several).tolist():
                        if (key := part.column("digest")[i].as_py()) not in seen:
                            seen.add(key)
                            fresh[i] = True
                    part = part.filter(pa.array(fresh))
                yield pa.record_batch([pa.array([version] * len(part)), part.column("digest"), pa.array(count(part.column("text").to_pylist()), pa.int64())], names=["version", "digest", "n_tokens"])

    misses.select("digest", "text", "several").mapInArrow(frugal(encode), kept).write.mode("append").parquet(cache)
    counts = _stored(spark, cache, kept).where(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    sizes = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sizes.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def _stored(spark: SparkSession, cache: str, schema: T.StructType) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(cache)
    return spark.createDataFrame([], schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call fills a cache of its own, so that its figures are those of a first run; `snapforge.token_cache` names a kept one."""
    cache = spark.conf.get("snapforge.token_cache", None) or fresh_path(spark, "token-cache")
    counts = count_tokens(table(spark, sf_dir, "documents"), cache, tokenizer="byte_bpe_50k.json")
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
