"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null as empty; the byte-level tokenizers normalise
nothing, so other content is taken as it is) together with the digest of the tokenizer's file. Keys that
the cache table holds are joined to their counts. Of the others one row each is picked by its id, and only
these rows are encoded; their counts are appended to the cache. Keys and numbers are joined, not texts, as long
as the table of repeated texts (or, with a cache, of missing ones) is small enough to be broadcast; the counts
come back to the rows by a join in which a text copied very often is no one task's work.

Repeated rows and copies share one encoding. Ids may be null. Other columns pass through, but for the
output columns, which must not exist already.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import named_apart, scratch_dir, small, spread_join, stored, table

CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])
KEY, COPIES, ID = "__siltstone_digest", "__siltstone_copies", "__siltstone_key_id"
#: Texts that a worker encodes at a time.
SLICE = 128

_loaded: dict[str, object] = {}


def read_tokenizer(path: str) -> tuple[str, bytes]:
    """Kind (the file's suffix) and content, read on the driver and broadcast: a fixed file of a few MB."""
    with open(path, "rb") as f:
        return path.rsplit(".", 1)[-1], f.read()


def _counter(kind: str, content: bytes):
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        if kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            _loaded[key] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(content.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[key] = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[key]


def _encode(rows: DataFrame, kind: str, content: bytes) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(kind, shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return rows.mapInArrow(run, "digest binary, n_tokens long")


def _cached(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """The cache's counts for the tokenizer; None if there is no table yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def token_counts(df: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text: str = "text", limit: int = 1024, keep_text: bool = True) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``cache_path``: the Parquet table of counts, made when missing, kept from run to run; None starts an
    empty one in the shared folder. Without ``keep_text`` the result lacks the texts, and they are read and
    digested twice only: for the keys, and for what is to be encoded.
    """
    named_apart(df, "n_bytes", "n_tokens", "over_limit")
    spark = df.sparkSession
    kind, content = read_tokenizer(tokenizer_path)
    version = hashlib.sha256(content).hexdigest()
    cache_path = cache_path or scratch_dir(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumn(KEY, F.unhex(F.sha2(body, 256)))
    rows = keyed.select(F.col(KEY).alias("digest"), F.col(id_col).cast("string").alias("id"), body.alias("body"))
    sized = keyed.withColumn("n_bytes", F.octet_length(body).cast("long"))
    narrow = keys = None
    if not keep_text:
        narrow = stored(sized.drop(text).withColumn(ID, F.col(id_col).cast("string")))
        keys = narrow.select(F.col(KEY).alias("digest"), F.col(ID).alias("id"))
    digests = stored((rows if keys is None else keys).groupBy("digest").agg(F.min("id").alias("one"), F.count(F.lit(1)).alias("n")))
    cached = _cached(spark, cache_path, version)
    if cached is None:  # all are missing: only the other rows of texts that come repeatedly stay out
        repeated = stored(digests.where("n > 1").select("digest", "one", F.lit(True).alias("repeated")))
        marked = rows.join(small(repeated), "digest", "left")
        misses = marked.where(F.col("repeated").isNull() | F.col("id").eqNullSafe(F.col("one")))
    else:
        missing = stored(digests.join(cached.select("digest"), "digest", "left_anti").select("digest", "one"))
        misses = rows.join(small(missing), "digest").where(F.col("id").eqNullSafe(F.col("one")))
    (
        _encode(misses.select("digest", "body"), kind, content)
        .groupBy("digest")  # rows of the same id and text
        .agg(F.lit(version).alias("tokenizer"), F.max("n_tokens").alias("n_tokens"))
        .write.mode("append")
        .parquet(cache_path)
    )
    counts = _cached(spark, cache_path, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = stored(digests.select(F.col("digest").alias(KEY), "n").join(counts.withColumnRenamed("digest", KEY), KEY).withColumnRenamed("n", COPIES))
    counted = sized if narrow is None else narrow.drop(ID)
    return spread_join(counted, known, KEY, COPIES).drop(KEY).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False).select("doc_id", "n_bytes", "n_tokens", "over_limit")
