"""Exact token counts from a length histogram: totals, quantiles and truncated totals for every context limit.

Documents are encoded whole and counted by encoded length; all else is sums over this histogram, which has
one row per distinct length.  Suffix sums are taken within blocks of neighbouring lengths, and over the
blocks' sums, so no task holds more than BLOCK lengths or one row per block.

Edge cases: null and empty texts have length 0; repeated rows count as often as they stand; an empty table
gives an empty histogram, totals of 0 and null quantiles; columns other than id and text are not looked at.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import durable, load

#: Lengths in a block.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of each document."""
    field = T.StructField("n_tokens", T.LongType())
    return bpe._assemble(docs, ranks, pattern, id_col, text_col, bpe.CHUNK, field, lambda ids, _: [pa.array([len(x) for x in ids], pa.int64())])


def length_histogram(lengths: DataFrame, n_col: str = "n_tokens", block: int = BLOCK) -> DataFrame:
    """Per length, taken as a context limit: documents of it, documents and tokens of at least it, share of documents up to it, tokens in all, and tokens when every document is cut at it."""
    h = durable(lengths.groupBy(F.col(n_col).alias("n_tokens")).agg(F.count("*").alias("docs")))
    h = h.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    sums = sums.select("block", *(F.coalesce(F.sum(x).over(longer), F.lit(0)).alias(f"{x}_above") for x in "dt"), *(F.sum(x).over(every).alias(f"{x}_all") for x in "dt"))
    up = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(sums, "block").select("*", (F.sum("docs").over(up) + F.col("d_above")).alias("docs_from"), (F.sum("tokens").over(up) + F.col("t_above")).alias("tokens_from"))
    return h.select("n_tokens", "docs", "docs_from", "tokens_from", F.col("t_all").alias("total_tokens"), ((F.col("d_all") - F.col("docs_from") + F.col("docs")) / F.col("d_all")).alias("quantile"), (F.col("t_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_tokens"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> dict[int, int]:
    """Tokens in all when every document is cut at each of ``limits``, whether or not a document has that length."""
    row = histogram.agg(*(F.sum(F.col("docs") * F.least("n_tokens", F.lit(x))) for x in limits)).first()
    return {x: n or 0 for x, n in zip(limits, row, strict=True)}


def quantiles(histogram: DataFrame, shares: list[float]) -> dict[float, int | None]:
    """The least length that at least each of ``shares`` (0 to 1) of the documents don't exceed."""
    row = histogram.agg(*(F.min(F.when(F.col("quantile") >= x, F.col("n_tokens"))) for x in shares)).first()
    return dict(zip(shares, row, strict=True))


def query(spark, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(load(spark, sf_dir, "documents"), *bpe.vocabulary()))
