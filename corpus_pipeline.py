"""A corpus pipeline: five stages, each over all documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyview.llm import bpe, jaccard, langid, mixing, secrets
from polyview.llm.common import durable, load

#: Documents whose language is undetermined or less certain than this go.
LEAST_SCORE = 0.3

STANDARD = ("doc_id", "text", "lang", "source", "n_chars")


def _guarded(stage):
    """``stage`` with further columns renamed meanwhile, so that their names can't clash with its own."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(spark, docs.toDF(*[n if n in STANDARD else f"extra_{i}" for i, n in enumerate(names)]), sf_dir).toDF(*names)

    return run


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no clear language; without labels to learn from, none."""
    model = langid.fit(langid.learnable(docs))
    if model is None:
        return docs
    found = langid.predict(docs, model, keep=[c for c in docs.columns if c != "doc_id"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return jaccard.keep_one(docs, n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the copy at a source's cut keeps the words that fit."""
    return mixing.apply_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes, per copy."""
    return bpe.digests(docs, *bpe.vocabulary())


STAGES = [("language ID", _guarded(language_id)), ("n-gram Jaccard join", _guarded(near_duplicates)), ("secret scans", _guarded(secret_scan)), ("source mixing", _guarded(mixing_stage)), ("byte-level BPE", encoding)]

#: The first stage is a neural network, which SQL cannot express; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
