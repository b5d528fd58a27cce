"""A corpus pipeline: five stages, each over all that the stage before it has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``documents``. A stage that changes a text
sets ``n_chars`` anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import line_dedup, near_dedup, packing, pii, toxicity
from siltstone.llm.common import table
from siltstone.sources.scratch import discard, settled

#: Documents that score as much or more are rejected.
TOXIC = 0.3


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the classifier rejects go. It learns from the rows of ``labels`` that aren't held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, model, out="__siltstone_score").where(F.col("__siltstone_score") < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: repeated lines go; the documents stay."""
    return _measured(line_dedup.deduplicate(docs, counts=("__siltstone_lines", "__siltstone_dropped")).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of near copies (five words, 0.8) the document of the smallest id stays."""
    return near_dedup.deduplicate(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data and terms that reveal it give way to placeholders."""
    return _measured(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the texts' tokens in sequences of 2,048."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: A trained model, sets of words and a tokenizer: not for SQL. The tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are stored; what a stage made on the way, and its own input, go when they are."""
    docs, at = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        kept, kept_at = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if at:
            discard(at)
        docs, at = kept, kept_at
    return STAGES[-1][1](spark, docs, sf_dir)
