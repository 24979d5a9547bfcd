"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage gets what the one before kept.  ``run`` writes every result as Parquet in the
folder that the cluster shares and reads it back, so a lost executor costs one stage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import bpe, decontaminate, language_id, line_dedup, simhash
from ledgerscope.llm.queries import table, vocabulary
from ledgerscope.session import tune


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` after texts were cut."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay."""
    tune(spark)
    return language_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that align with an earlier document go, and documents with nothing left."""
    tune(spark)
    return _recounted(line_dedup.remove_duplicate_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    tune(spark)
    return simhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Test items are cut out of contaminated documents; those mostly made of them go."""
    return _recounted(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of their decoded text."""
    tune(spark)
    done = bpe.tokenised(docs, vocabulary(), carry=["doc_id", "lang", "source"])
    return done.select("row.*", "result.*")


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", tokens),
]

# The stages learn, align and join fingerprints, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        # A folder of this machine serves a local session only.
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="corpus-")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
