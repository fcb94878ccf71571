"""A corpus made ready for training: five stages, each on all that the one before it kept.

language ID, MinHash near-dedup, PII, mixing sources to target weights, best-fit packing. Each stage's result is written to the shared
folder as Parquet and read again. Each begins with a collection of garbage on the executors, whose heaps the stage before it has grown.

In every stage an empty table stays empty, further columns stay (but for the last stage, which returns its own), and a null text counts as
empty: the first stage drops it, as it holds no letter; given to a later one, it is a document of its own, without shingles, personal data
or words."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.llm import common
from graphtables.llm.language import UNKNOWN, identify, train
from graphtables.llm.mixing import materialise
from graphtables.llm.near_duplicates import without_near_duplicates
from graphtables.llm.packing import best_fit_packing
from graphtables.llm.pii import find, sanitised

#: A language less sure than this is no language that the corpus holds.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus's labels teach; texts without letters, and those of no such language, go.

    The posterior only chooses among the learned languages; a text must also be about as likely in the chosen one as its labelled texts.
    How many texts a language has says nothing of a single one here: all languages are equally likely beforehand.

    Without any label nothing can be judged, and all stay. A missing lang is filled with the predicted one. Repeated rows share their fate."""
    common.collect_garbage(spark)
    model = train(docs)
    if not model.languages:
        return docs
    names = [f"_pipeline_{x}" for x in ("lang", "sure", "fit")]
    lang, sure, fit = map(F.col, names)
    model = replace(model, prior=np.zeros(len(model.languages)))
    judged = identify(docs, model, out=names[0], score=names[1], fit=names[2]).where((lang != UNKNOWN) & (sure >= SURE) & fit)
    return judged.withColumn("lang", F.coalesce("lang", lang)).select(*[F.col(f"`{x}`") for x in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more.

    The one with the least doc_id stays; of rows equal in id and text one; rows without an id all stay, as do texts without words."""
    common.collect_garbage(spark)
    return without_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data and secrets, and of terms that disclose them; n_chars follows the text. A null
    text stays null; repeated rows are treated alike."""
    common.collect_garbage(spark)
    own = {x: f"_pipeline_{x}" for x in docs.columns if x.lower() in ("base", "named", "spans", "removed")}  # names that find() gives
    clean = find(docs.withColumnsRenamed(own)).withColumn("text", sanitised("text"))
    clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*[F.col(f"`{own.get(x, x)}`").alias(x) for x in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix of sources takes it; a null source is a source. Documents without words are never taken;
    rows of one id as often as the most taken of them."""
    common.collect_garbage(spark)
    return materialise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences; a document that comes twice has its pieces twice. An empty one is a piece of one token."""
    common.collect_garbage(spark)
    return best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages learn, hash and pack; SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
