"""Registered queries of the corpus operators, one per operator, and the pipeline."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.session import tune

QUERIES: dict[str, tuple] = {}


def register(name: str, sql: str | None = None):
    def add(job):
        QUERIES[name] = (job, sql)
        return job

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer file; ``TOKENIZERS_DIR`` names another folder."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


@register("op6_bpe")
def op6(spark, sf_dir):
    from ledgerscope.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


@register("op2_decontaminate")
def op2(spark, sf_dir):
    from ledgerscope.llm import decontaminate

    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op7_language_id")
def op7(spark, sf_dir):
    from ledgerscope.llm import language_id

    return language_id.identify(table(spark, sf_dir, "documents"))


@register("op5_simhash")
def op5(spark, sf_dir):
    from ledgerscope.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op10_secrets")
def op10(spark, sf_dir):
    from ledgerscope.llm import secrets

    return secrets.report(table(spark, sf_dir, "documents"))


@register("op3_chat_format")
def op3(spark, sf_dir):
    from ledgerscope.llm import chat

    return chat.digests(chat.with_probe(table(spark, sf_dir, "conversations")))


@register("op8_toxicity")
def op8(spark, sf_dir):
    from ledgerscope.llm import toxicity

    return toxicity.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op9_neighbours")
def op9(spark, sf_dir):
    from pyspark.sql import functions as F

    from ledgerscope.llm import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@register("op1_line_dedup")
def op1(spark, sf_dir):
    from ledgerscope.llm import line_dedup

    return line_dedup.report(table(spark, sf_dir, "documents"))


@register("op4_substring_dedup")
def op4(spark, sf_dir):
    from ledgerscope.llm import substring_dedup

    return substring_dedup.passages(table(spark, sf_dir, "documents"))


@register("op12_whitening")
def op12(spark, sf_dir):
    from ledgerscope.llm import whitening

    return whitening.report(table(spark, sf_dir, "embeddings"))


@register("op11_embedding_dedup")
def op11(spark, sf_dir):
    from ledgerscope.llm import embedding_dedup

    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op13_alignment")
def op13(spark, sf_dir):
    from ledgerscope.llm import alignment

    return alignment.alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
