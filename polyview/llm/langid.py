"""Language identification: a bidirectional GRU over bytes, trained in numpy.

A text's UTF-8 bytes are cut into windows; in each window one GRU runs forwards and one backwards, and
a softmax over both states labels every byte with language probabilities.  A document's probabilities
are the mean over all of its bytes.  Training is backpropagation through time with Adam on a bounded
sample: ``per_lang`` documents of each language, ``windows`` windows of each.

Scoring is a map over Arrow batches; the model is a few kilobytes.  Equal texts inside a batch are
scored once.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; texts of any length are
scored whole; null labels are not learned from; without a usable label everything is ``und``; repeated
rows stay; of equal probabilities the first language (by name) is taken; an empty table gives no rows;
columns other than id, text and label are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, load

PAD = 256


@dataclass
class BiGRU:
    """emb (2, 257, 3H): input part of the gates for each byte and direction; rec (2, 3H, H); bias of the candidate's recurrent part (2, H, 1); out (K, 2H); off (K, 1)."""

    langs: list[str]
    emb: np.ndarray
    rec: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    off: np.ndarray

    @property
    def params(self):
        return [self.emb, self.rec, self.bias, self.out, self.off]

    @classmethod
    def start(cls, langs: Sequence[str], hidden: int, rng: np.random.Generator) -> BiGRU:
        f, h, k = np.float32, hidden, len(langs)
        return cls(list(langs), (rng.standard_normal((2, 257, 3 * h)) * 0.5).astype(f), (rng.standard_normal((2, 3 * h, h)) / np.sqrt(h)).astype(f), np.zeros((2, h, 1), f), (rng.standard_normal((k, 2 * h)) * 0.3).astype(f), np.zeros((k, 1), f))


def _forward(m: BiGRU, x: np.ndarray, keep: bool = False):
    """Window bytes x (T, B) -> states (T, 2H, B), and what backpropagation needs.

    Gates are sigmoid(a) = (1 + tanh(a / 2)) / 2; the halves are part of the pre-activations, so all gates
    of a step take one tanh.  Padding lies at the end of a window and is masked by the caller.
    """
    steps, width = x.shape
    h = m.rec.shape[2]
    states = np.empty((steps, 2 * h, width), np.float32)
    saved = []
    for d in (0, 1):
        table, rec, bias = np.ascontiguousarray(m.emb[d].T), m.rec[d], m.bias[d]
        now = np.zeros((h, width), np.float32)
        own = states[:, d * h : (d + 1) * h]
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = table.take(x[t], axis=1)
            u = rec @ now
            g = a[: 2 * h]
            g += u[: 2 * h]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            un = u[2 * h :]
            un += bias
            c = a[2 * h :]
            c += g[h:] * un
            np.tanh(c, out=c)
            prev, now = now, c + g[:h] * (now - c)
            own[t] = now
            if keep:
                saved.append((d, t, g, un, c, prev))
    return states, saved


def _softmax(m: BiGRU, states: np.ndarray) -> np.ndarray:
    p = np.matmul(m.out, states)
    p += m.off
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def gradients(m: BiGRU, x: np.ndarray, y: np.ndarray):
    """Mean cross entropy of all bytes that aren't padding, and its gradients by backpropagation through time."""
    steps, width = x.shape
    h = m.rec.shape[2]
    states, saved = _forward(m, x, keep=True)
    p = _softmax(m, states)
    mask = (x != PAD).astype(np.float32)
    n = mask.sum()
    at = np.arange(width)
    loss = float(-(np.log(np.maximum(p[:, y, at], 1e-12)) * mask).sum() / n)
    p[:, y, at] -= 1
    p *= mask[:, None] / n
    grads = [np.zeros_like(a) for a in m.params]
    g_emb, g_rec, g_bias, g_out, g_off = grads
    g_out += np.matmul(p, states.transpose(0, 2, 1)).sum(axis=0)
    g_off += p.sum(axis=(0, 2))[:, None]
    back = np.matmul(m.out.T, p)
    carry = None
    for d, t, g, un, c, prev in reversed(saved):
        if carry is None or carry[0] != d:
            carry = (d, np.zeros((h, width), np.float32))
        dh = back[t, d * h : (d + 1) * h] + carry[1]
        z, r = g[:h], g[h:]
        dz = dh * (prev - c)
        dc = dh * (1 - z) * (1 - c * c)
        dun = dc * r
        # d sigmoid as (1 + tanh(v)) / 2 of its pre-activation v: 2 s (1 - s)
        da = np.concatenate([dz * 2 * z * (1 - z), dc * un * 2 * r * (1 - r), dc])
        du = np.concatenate([da[: 2 * h], dun])
        g_rec[d] += du @ prev.T
        g_bias[d] += dun.sum(axis=1, keepdims=True)
        np.add.at(g_emb[d], x[t], da.T)
        carry = (d, dh * z + m.rec[d].T @ du)
    return loss, grads


def windows_of(data: bytes, size: int) -> np.ndarray:
    """Windows (n, size) of byte numbers, the last padded with PAD."""
    n = -(-len(data) // size)
    out = np.full(n * size, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


def train(samples: Sequence[tuple[bytes, str]], hidden: int = 8, size: int = 64, steps: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 5) -> BiGRU | None:
    """Fit on (bytes of a window, language) pairs."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    m = BiGRU.start(langs, hidden, rng)
    x = np.concatenate([windows_of(b[:size], size) for b, _ in samples])
    y = np.array([langs.index(lang) for _, lang in samples])
    if len(langs) == 1:
        return m
    groups = [np.flatnonzero(y == k) for k in range(len(langs))]
    first, second = [np.zeros_like(a) for a in m.params], [np.zeros_like(a) for a in m.params]
    for i in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, -(-batch // len(groups))) for g in groups])
        _, grads = gradients(m, x[pick].T, y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1, 2 * (1 - i / (steps + 1)))
        for p, g, a, b in zip(m.params, grads, first, second, strict=True):
            g *= min(1.0, 1.0 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (lr * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return m


def label_bytes(m: BiGRU, data: bytes, size: int = 64) -> np.ndarray:
    """Language probabilities of each byte: (len(data), K)."""
    if not data:
        return np.zeros((0, len(m.langs)), np.float32)
    p = _softmax(m, _forward(m, np.ascontiguousarray(windows_of(data, size).T))[0])
    return p.transpose(2, 0, 1).reshape(-1, len(m.langs))[: len(data)]


def pool(m: BiGRU, texts: list[bytes], size: int = 64, width: int = 1024) -> np.ndarray:
    """Mean of the byte probabilities of each text: (len(texts), K); zeros for an empty text. ``width`` windows go at once."""
    sums = np.zeros((len(texts), len(m.langs)))
    held, owner, n = [], [], 0

    def flush():
        x = np.ascontiguousarray(np.concatenate(held).T)
        who = np.concatenate(owner)
        for at in range(0, x.shape[1], width):
            part = np.ascontiguousarray(x[:, at : at + width])
            p = _softmax(m, _forward(m, part)[0])
            p *= (part != PAD)[:, None]
            np.add.at(sums, who[at : at + width], p.sum(axis=0).T)
        held.clear()
        owner.clear()

    for i, data in enumerate(texts):
        # a long text goes in pieces of whole windows
        for at in range(0, len(data), size << 14):
            w = windows_of(data[at : at + (size << 14)], size)
            held.append(w)
            owner.append(np.full(len(w), i))
            n += len(w)
            if n >= 4 * width:
                flush()
                n = 0
    if held:
        flush()
    return sums / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, windows: int, size: int) -> list[tuple[bytes, str]]:
    """At most per_lang * windows windows of each language: documents by a hash of their content, windows spread evenly over each."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.regexp_like(F.coalesce(text_col, F.lit("")), F.lit(r"\p{L}")))
    length = F.length(text_col)
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.substring(F.col(text_col), (F.floor(length * k / windows) + 1).cast("int"), F.lit(size)))
    thin = usable.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.array_distinct(cut).alias("cut"))
    # a hash threshold for each language leaves some 4 * per_lang of its documents, whatever their number, to be ranked
    counts = {r["lang"]: r["count"] for r in usable.groupBy(F.col(lang_col).alias("lang")).count().toLocalIterator()}
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(4.0 * per_lang / n)) for lang, n in counts.items()], F.lit(1.0))
    thin = thin.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    top = thin.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.col("cut")[0]))).where(F.col("rank") <= per_lang)
    return sorted((w.encode(), r.lang) for r in top.select("lang", "cut").toLocalIterator() for w in r.cut if w)


def predict(docs: DataFrame, m: BiGRU | None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), size: int = 64) -> DataFrame:
    """(id, *keep, lang_pred, score): the language with the highest pooled probability."""
    fields = [docs.schema[id_col], *(docs.schema[c] for c in keep)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(m)
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f.name for f in fields]
    at = len(names)

    def run(batches):
        model = shared.value
        for b in batches:
            texts = [x.encode() if ok else b"" for x, ok in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), strict=True)]
            first: dict[bytes, int] = {}
            which = [first.setdefault(t, len(first)) for t in texts]
            if model is None:
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
            else:
                p = pool(model, list(first), size)[which]
                best = p.argmax(axis=1)
                lang = [model.langs[k] if t else "und" for k, t in zip(best, texts, strict=True)]
                score = [min(1.0, float(s)) if t else 0.0 for s, t in zip(p[np.arange(len(p)), best], texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema.names)

    has_letter = F.regexp_like(text, F.lit(r"\p{L}"))
    return docs.select(*names, text.alias("__text"), has_letter.alias("__letter")).mapInArrow(run, schema)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, windows: int = 4, size: int = 64, **params) -> BiGRU | None:
    """Learn from ``docs`` (all of which may be learned from)."""
    return train(training_windows(docs, id_col, text_col, lang_col, per_lang, windows, size), size=size, **params)


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(crc_mod(F.col(id_col), 3) != 1)


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, fit(learnable(docs)))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
