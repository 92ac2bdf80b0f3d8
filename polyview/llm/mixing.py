"""Mix sources to target weights: hash-random keys, range sort, distributed prefix sums, exact cuts.

Every document gets a key that is uniform at random but fixed by its content.  The thin table of
(source, key, size) is range-partitioned by source and key, so a source of any size spreads over
many partitions; sums per partition turn into offsets, and offset plus the running sum inside the
partition is the document's place in its source's random order.  A source with target ``t`` and
``s`` words runs through ``floor(t / s)`` whole epochs; the next epoch is cut at the exact word.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own and the
last in order; a null id counts as an empty one; repeated rows are separate documents; an empty
table gives no rows.  Columns of the input other than id, text and source are not looked at, so
their names may clash with those of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, load, partitions


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3) -> DataFrame:
    """Targets of sources: (skey, source, source_size) -> the same and weight, target.

    Shares are proportional to weight; none goes above ``max_epochs`` times its source's size, and
    what is left over is reshared among the others until none is above.  The fixed point of the
    resharing is min(cap, level * weight), found with one sort by cap / weight.  The table has one
    row per source, so the windows here see sources, never documents.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.select("skey", "source", "source_size", w.alias("weight"))
    t = t.select("*", (F.col("source_size") * float(max_epochs)).alias("cap"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) - before) / after
    t = t.select("*", level.alias("level"), F.row_number().over(order).alias("rank"))
    t = t.select("*", F.min_by(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")), F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("rank"))).over(whole).alias("at"))
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight")))
    return t.select("skey", "source", "source_size", "weight", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, seed: int = 7, keep_key: bool = False) -> DataFrame:
    """One row per document: id, source, size, source_size, target, epochs, part, taken.

    ``epochs`` whole copies and the first ``part`` words of one more copy are taken; ``taken`` =
    epochs * size + part.  The sum of ``taken`` over a source is floor(target).  ``keep_key`` adds
    ``mix_key``, the md5 of seed, id and text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text))
    thin = durable(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("skey"),
            key.alias("mix_key"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        )
    )
    targets = source_targets(thin.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), weights, max_epochs).drop("source")
    ranged = durable(thin.repartitionByRange(partitions(docs.sparkSession), "skey", "mix_key").withColumn("pid", F.spark_partition_id()))
    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = ranged.withColumn("within", earlier(Window.partitionBy("skey", "pid").orderBy("mix_key")))
    sums = ranged.groupBy("skey", "pid").agg(F.sum("size").alias("size"))
    offsets = sums.select("skey", "pid", earlier(Window.partitionBy("skey").orderBy("pid")).alias("offset"))
    epochs = F.floor(F.col("target") / F.col("source_size"))
    scale = offsets.join(targets, "skey").select("skey", "pid", "offset", "source_size", "target", F.coalesce(F.when(F.col("source_size") > 0, epochs), F.lit(0)).alias("epochs"))
    scale = scale.withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    start = F.col("offset") + F.col("within")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    out = local.join(scale, ["skey", "pid"]).withColumn("part", part.cast("long"))
    cols = [F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), "part", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")]
    return out.select(*cols, *(["mix_key"] if keep_key else []))


def first_words(text, n):
    """The text up to the end of its ``n``-th word (n >= 1): the lengths of n gaps and words, summed."""
    lengths = lambda parts: F.aggregate(F.slice(parts, F.lit(1), n.cast("int")), F.lit(0), lambda acc, x: acc + F.length(x))
    return F.substring(text, F.lit(1), lengths(F.split(text, WORD, -1)) + lengths(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mixed documents: columns of ``docs``, one row per whole or cut copy that the mix takes.

    The copy at a source's cut keeps the words the budget still has room for (its ``n_chars``, if
    there is such a column, follows).
    """
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name clashes with one in here
    cols = docs.columns
    id_col, text_col, source_col = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    seed = params.get("seed", 7)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)))
    # Identical rows share a key; their plans are handed out in turn.
    plan = mix_sources(docs, id_col, text_col, source_col, keep_key=True, **params).where("taken > 0").select("mix_key", F.col(source_col).alias("mix_source"), "size", "epochs", "part", F.row_number().over(Window.partitionBy("mix_key", source_col).orderBy(F.desc("taken"))).alias("mix_turn"))
    keyed = keyed.withColumn("mix_turn", F.row_number().over(Window.partitionBy("mix_key", source_col).orderBy(F.lit(0))))
    joined = keyed.alias("d").join(plan.alias("p"), (F.col("d.mix_key") == F.col("p.mix_key")) & F.col(f"d.{source_col}").eqNullSafe(F.col("p.mix_source")) & (F.col("d.mix_turn") == F.col("p.mix_turn")))
    copies = F.concat(F.array_repeat(F.col("p.size"), F.col("p.epochs").cast("int")), F.when(F.col("p.part") > 0, F.array(F.col("p.part"))).otherwise(F.array().cast("array<bigint>")))
    out = joined.select(*[F.col(f"d.{c}").alias(c) for c in cols], F.col("p.size").alias("mix_size"), F.explode(copies).alias("mix_words"))
    cut = F.when(F.col("mix_words") < F.col("mix_size"), first_words(F.col(text_col), F.col("mix_words"))).otherwise(F.col(text_col))
    out = out.withColumn(text_col, cut)
    if "n_chars" in names:
        size = f"c{names.index('n_chars')}"
        out = out.withColumn(size, F.when(F.col("mix_words") < F.col("mix_size"), F.length(text_col).cast("long")).otherwise(F.col(size)))
    return out.select(*cols).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat_ws('|', '7', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rnk
  FROM w),
a AS (SELECT arg_min(level, rnk) AS lv FROM l WHERE cap > level * weight),
t AS (SELECT source, source_size, CAST(CASE WHEN lv IS NULL THEN cap ELSE least(cap, lv * weight) END AS DOUBLE) AS target FROM l CROSS JOIN a),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT doc_id, d.source, size, source_size, target, epochs, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM p
"""
