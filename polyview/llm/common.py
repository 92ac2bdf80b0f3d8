"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the one that driver and executors share (spark.checkpoint.dir); it goes when the driver ends.

    Where the setting is absent a temporary folder is used if all of Spark runs in this process, as in
    tests; on a cluster, whose executors would not see that folder, this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        root = tempfile.mkdtemp(prefix="polyview-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/pv-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def durable(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def tokenise(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of each word, words per text, and the distinct words (strings, A-Z lower-cased) of a column of texts.

    ASCII white space is \\x20 \\x09-\\x0D, as in ``WORD``; a null text has no word.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    lengths = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(column))
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths, coded.dictionary


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


_MB = re.compile(r"\s*(\d+)\s*([kmgt]?)b?\s*$", re.I)


def byte_size(value: str, default: int = 8 << 20) -> int:
    """Bytes of a setting such as 8m."""
    m = _MB.match(value or "")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2].lower()] if m else default
