"""From raw documents to packed training sequences: five stages over the operators of ``cuelake.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns they were given, further ones included, whatever their names;
a stage over an empty table gives an empty one.  Repeated rows and rows without a doc_id are rows like
others, unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm.common import stored, tokenizer_path
from cuelake.llm.langid import keep_known
from cuelake.llm.packing import pack
from cuelake.llm.pii import redact
from cuelake.llm.quality import keep_good
from cuelake.llm.queries import END_ID, WORD_BPE
from cuelake.llm.similar import keep_dissimilar


#: Rows of an Arrow batch: texts are long rows, and what a worker and the JVM hold beside a batch grows with it.
ARROW_ROWS = 500
ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it has a lower bound."""
    if not 0 < int(spark.conf.get(ARROW_SETTING)) <= ARROW_ROWS:
        spark.conf.set(ARROW_SETTING, ARROW_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts that are null or without letters go, and all where no row has a language to learn from."""
    _small_batches(spark)
    return keep_known(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the trees call good; null and empty texts fail the rules (too few words)."""
    _small_batches(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles: that of the smallest doc_id.

    Of rows with the same smallest id one stays, a row without an id only if none of its group has one; texts without a word are alike.
    """
    _small_batches(spark)
    return keep_dissimilar(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; overlapping spans become one, named after the first.  Null texts stay null."""
    _small_batches(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; a null or empty text is its end token alone."""
    _small_batches(spark)
    return pack(docs, tokenizer_path(WORD_BPE), END_ID)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fitted models and fingerprints are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
