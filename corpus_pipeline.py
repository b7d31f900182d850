"""Corpus cleaning: language, toxicity, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of ``documents``; the last returns packed pieces.  Nulls,
empty tables and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import forest, graph, langid, packing, pii, toxicity
from plumbline.session import ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document without a letter or in no learned language goes, and one whose main language has too few of its letters (score below this).
SURE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; the labels given teach the model.

    ``lang`` becomes the predicted language where it was null.
    """
    model = langid.fit(docs, usable=~langid.held_out("doc_id"))
    return langid.keep(docs.select(*COLUMNS), model, least=SURE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out("doc_id"))
    return toxicity.keep(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group; rows with one id and different texts are documents of their own, null ids stay."""
    return forest.keep(docs.select(*COLUMNS), threshold=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    return pii.clean(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    import public_tokenizers

    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: Learned models and hashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread.

    The tables that a stage reads are removed once the next one is written, so only
    those of the last two stages are left for the result.
    """
    docs = table(ship(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs, _ = graph.write(made)
        for path in graph.tables_of(made):
            graph.remove(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
