"""Media columns: store binary payloads as AVI motion-JPEG, read them back, and cut them into timed clips.

Both directions are maps over rows (Arrow batches, no shuffle); memory is bounded by one batch of a few
megabytes and one file.

Edge cases: a null text is an empty one; an empty payload becomes one line of zeros; repeated rows stay;
other columns of the input are not touched and not returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load

STEP = 4 << 20


def padded(data: bytes, to: int = 64) -> bytes:
    return data + b"\0" * ((-len(data)) % to if data else to)


def _rows(batches, step: int = STEP):
    """Slices of the batches whose second column holds about ``step`` bytes, never less than a row."""
    for b in batches:
        sizes, at, total = [len(x.as_buffer() or b"") if x.is_valid else 0 for x in b.column(1)], 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > step:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < len(sizes):
            yield b.slice(at)


def store_media(payloads: DataFrame, id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """(id, media): each payload as an AVI file; it is padded with zeros to a positive multiple of 64."""
    from . import avi

    def run(batches):
        for b in _rows(batches):
            media = [avi.write_avi(padded(x or b"")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], [id_col, "media"])

    schema = T.StructType([T.StructField(id_col, payloads.schema[id_col].dataType), T.StructField("media", T.BinaryType())])
    return payloads.select(id_col, F.col(payload_col).cast("binary").alias(payload_col)).mapInArrow(run, schema)


CLIP = "array<struct<first_frame:int,frames:int,start_ms:bigint,end_ms:bigint,level:double>>"


def read_media(files: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, media, payload, frames, clips): decoded samples and timed clips of each file."""
    from . import avi

    schema = T.StructType([T.StructField(id_col, files.schema[id_col].dataType), T.StructField("media", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("frames", T.IntegerType()), T.StructField("clips", T._parse_datatype_string(CLIP))])

    def one(data: bytes):
        head, frames = avi.read_avi(data)
        parts, hists = [], []
        for planes in avi.decode(frames):
            parts += [p.tobytes() for p in planes]
            hists.append(avi.histograms(planes))
        hist, us = np.concatenate(hists), head["frame_us"]
        grey = hist @ (np.arange(16) * 16 + 8)
        clips = [{"first_frame": a, "frames": b - a, "start_ms": a * us // 1000, "end_ms": b * us // 1000, "level": float(np.round(grey[a:b].mean(), 3))} for a, b in avi.shots(hist)]
        return b"".join(parts), len(frames), clips

    def run(batches):
        for b in _rows(batches):
            done = [one(x) for x in b.column(1).to_pylist()]
            clips = pa.array([d[2] for d in done], pa.list_(pa.struct([("first_frame", pa.int32()), ("frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("level", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int32()), clips], schema.names)

    return files.select(id_col, F.col(media_col).alias("media")).mapInArrow(run, schema)


def clip_rows(read: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per clip: id, clip, first_frame, frames, start_ms, end_ms, level."""
    return read.select(id_col, F.posexplode("clips").alias("clip", "c")).select(id_col, "clip", "c.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.struct("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    read = read_media(store_media(docs))
    size = F.octet_length("payload")
    clips = F.array_join(F.transform("clips", lambda c: F.concat_ws(":", c.start_ms.cast("string"), c.end_ms.cast("string"), c.level.cast("string"))), ",")
    return read.select(
        F.col("id.doc_id").alias("doc_id"), F.col("id.n").alias("n_bytes"), size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), F.col("frames").cast("string"), F.lit(";clips="), clips).alias("feature"), F.size("clips").cast("long").alias("n_clips"),
    )
