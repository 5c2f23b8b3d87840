"""From raw documents to packed training sequences, stage by stage.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last keep the columns of
documents.

Nulls: a null text is an empty one; it passes the first two stages unchanged, is linked with nothing, has no
words to be mixed and so leaves in the mix, like every text without words. Rows with a null id are judged like others;
those of one source share a place in the mixing queue. A null source is a source of its own, a null language or length is
kept. Repeated rows are one document for line dedup and near copies (one stays), and are classified and packed one by one.
An empty table gives an empty result at every stage. Extra columns are kept up to the last stage, whatever their names:
results of the stages are never taken from, or put into, a column of documents but text and n_chars.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import jaccard, line_dedup, mixing, packing, toxicity
from framelake.llm import text as T
from framelake.llm.queries import tokenizer_path


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def keeping_extras(stage):
    """The stage with extra columns out of its way: they are renamed before it and take their names again after it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c.lower() in OWN else f"_extra_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])

    return run


@keeping_extras
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this corpus' labels, doesn't call toxic."""
    model = toxicity.fit(docs, T.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns).where("predicted = 0").select(*docs.columns)


@keeping_extras
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document of which nothing is left goes."""
    kept = line_dedup.dedup(docs).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@keeping_extras
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8 or more)."""
    return jaccard.representatives(docs, width=5, least=80).select(*docs.columns)


@keeping_extras
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight; a document taken twice is two rows."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and places in sequences."""
    return packing.pack(T.stored(packing.pieces(docs, tokenizer_path()), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifier, SimHash and tokenizer can't be said in SQL; the tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written to the shared folder."""
    docs = T.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = T.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
