"""Secret scans with DataFrame functions only: fixed patterns plus character Markov models.

Three patterns give base spans.  Beside them, two first-order character Markov models, one of random
strings and one of ordinary identifiers, are trained from labelled samples; a long run of identifier
characters is reported when the mean log-likelihood ratio of the character pairs of the run, or of any
long enough stretch of its parts between '=', '/', '_' and '-', reaches a threshold and the run has both a
digit and a letter; a base span may overlap it.  A key behind or before an ordinary name or path is
thus judged by itself; the span is the whole run.  Everything is built-in expressions, so the scan is
one projection over the documents without a shuffle.

Edge cases: a null or empty text has no spans; texts of any length are scanned whole; offsets are
code points, end exclusive; spans of different kinds may overlap, and those of equal start come in the
order of KINDS; rows repeat as they come; an empty table gives no rows; a column named secret_spans is
replaced by the result, all other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

# The patterns of the base kinds.  A match whose secret part is too short is dropped.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
#: Runs are maximal, so asking for the least length inside the pattern finds the same matches.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: Least length of a run, and of a stretch of its parts, that the models judge, and the least mean log-likelihood ratio (natural log).
MARKOV_MIN = 20
MARKOV_RUN = rf"[A-Za-z0-9+/_=-]{{{MARKOV_MIN},}}"
MARKOV_LEAST = 0.4
#: What parts a run.  A stretch that reaches the threshold and is not two shorter ones of the least length, of which
#: one then reaches it too, has at most MARKOV_MIN + 1 parts, so no longer stretch need be looked at.
MARKOV_CUT = "[=/_-]+"
MARKOV_PARTS = MARKOV_MIN + 1
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Samples of random strings that training makes by rule.
N_RANDOM = 4000
# Parts of ordinary identifiers, in four languages and code.
PARTS = (
    "user account name first last email address street city country phone number order item price total amount count index "
    "value result response request handler service client server config default option setting parameter argument function "
    "method class object instance module package version release build test example sample data model table column row record "
    "field query filter sort group join update delete insert create read write open close start stop begin end time date year "
    "month day hour minute second file path folder image video audio text string message error warning debug info log level "
    "nombre usuario pedido precio valor fecha cuenta ciudad nom utilisateur commande prix valeur fichier compte ville benutzer "
    "bestellung preis wert datei konto stadt nachricht fehler international communication development organization information "
    "gesellschaft verantwortung entwicklung wissenschaft responsabilidad comunicacion desarrollo developpement gouvernement"
).split()


def training_samples(spark: SparkSession) -> DataFrame:
    """Labelled samples (text, label): 1 = random string, 0 = ordinary identifier."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = spark.range(N_RANDOM).select(
        F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40))
        .when(F.col("id") % 3 == 1, F.regexp_replace(F.base64(F.unhex(digest)), "=+$", ""))
        .otherwise(F.upper(F.conv(F.substring(digest, 1, 15), 16, 36))).alias("text"),
        F.lit(1).alias("label"),
    )
    n, parts = len(PARTS), F.array(*[F.lit(p) for p in PARTS])
    part = lambda k: F.element_at(parts, (F.floor(F.col("id") / F.lit(k)) % n + 1).cast("int"))
    ids = spark.range(n * 8).select("id", part(1).alias("a"), F.element_at(parts, ((F.col("id") * 7 + F.floor(F.col("id") / n) * 31 + 3) % n + 1).cast("int")).alias("b"))
    forms = F.array(
        F.concat_ws("_", "a", "b"), F.concat("a", F.initcap("b")), F.concat_ws("-", "a", "b"), F.concat_ws("_", F.upper("a"), F.upper("b")),
        F.concat(F.initcap("a"), "b"), F.concat_ws("/", "a", "b"), F.concat("a", "b", (F.col("id") % 2030).cast("string")), F.concat_ws("-", (F.col("id") % 13).cast("string"), "a", (F.col("id") + 1990).cast("string")),
    )
    return random.unionByName(ids.select(F.explode(forms).alias("text"), F.lit(0).alias("label")))


def train(samples: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Log-likelihood ratios of character pairs: (pair, llr), all pairs of ALPHABET, add-one smoothed.

    Characters outside ALPHABET, null texts and null labels are left out.
    """
    spark = samples.sparkSession
    size = len(ALPHABET)
    text = F.col(text_col)
    pairs = samples.where(F.length(text) >= 2).select(F.col(label_col).alias("label"), F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("pair").agg(*[F.count_if(F.col("label") == k).alias(f"n{k}") for k in (0, 1)])
    chars = spark.range(size).select(F.substring(F.lit(ALPHABET), (F.col("id") + 1).cast("int"), F.lit(1)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"))
    grid = chars.select("c", F.concat("c", F.substring(F.lit(ALPHABET), F.col("j") + 1, F.lit(1))).alias("pair"), (F.instr(F.lit(ALPHABET), F.col("c")) * size + F.col("j")).alias("at"))
    full = grid.join(counts, "pair", "left").fillna(0, ["n0", "n1"])
    sums = full.groupBy("c").agg(*[(F.sum(f"n{k}") + size).alias(f"s{k}") for k in (0, 1)])
    llr = F.log((F.col("n1") + 1) / F.col("s1")) - F.log((F.col("n0") + 1) / F.col("s0"))
    return full.join(sums, "c").select("pair", "at", llr.alias("llr"))


def model_literal(model: DataFrame) -> Column:
    """The ratios as one constant array; it always has len(ALPHABET) ** 2 entries, whatever the data."""
    rows = model.select("at", "llr").orderBy("at").collect()
    return F.split(F.lit(",".join(repr(r.llr) for r in rows)), ",").cast("array<double>")


def sum_llr(run: Column, llr: Column) -> Column:
    """Sum of the log-likelihood ratios of the character pairs of ``run`` (all characters in ALPHABET); 0 if it has no pair."""
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(run, i, F.lit(1))) - 1
    total = F.aggregate(F.sequence(F.lit(1), F.length(run) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(llr, F.greatest(at(i) * len(ALPHABET) + at(i + 1) + 1, F.lit(1)).cast("int")))
    return F.when(F.length(run) >= 2, total).otherwise(F.lit(0.0))


def mean_llr(run: Column, llr: Column) -> Column:
    """Mean log-likelihood ratio of the character pairs of ``run`` (all characters in ALPHABET, two or more)."""
    return sum_llr(run, llr) / (F.length(run) - 1)


def stretch_reaches(run: Column, llr: Column, least: float) -> Column:
    """Whether neighbouring parts of ``run``, MARKOV_MIN characters or more, have a mean ratio of ``least`` or more.

    The mean is the sum over the pairs inside the parts per character of theirs; the time is linear in the length of the run.
    """
    parts = F.transform(F.filter(F.split(run, MARKOV_CUT), lambda p: F.length(p) > 0), lambda p: F.struct(F.length(p).alias("n"), (sum_llr(p, llr) - F.length(p) * F.lit(least)).alias("extra")))
    zero = F.struct(F.lit(-1).alias("n"), F.lit(0.0).alias("extra"), F.lit(False).alias("hit"))

    def step(acc, p):
        n, extra = acc.n + 1 + p.n, acc.extra + p.extra
        return F.struct(n.alias("n"), extra.alias("extra"), (acc.hit | ((n >= MARKOV_MIN) & (extra >= 0))).alias("hit"))

    # the one-element array is so that the parts are computed once
    return F.exists(F.array(parts), lambda ps: (F.size(ps) > 0) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(ps), F.lit(1))), lambda i: F.aggregate(F.slice(ps, i, F.lit(MARKOV_PARTS)), zero, step).hit))


def _found(text: Column, pattern: str, group: int) -> Column:
    """Matches of ``pattern`` in order: array of (gap before, whole match, group); null if there is none."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    zipped = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    return F.when(F.regexp_like(text, F.lit(pattern)), zipped)


_SPANS = "array<struct<start:int,kind:int,end:int,part:string>>"
_HOLES = "array<struct<start:int,end:int,fresh:boolean>>"
#: Matches that are folded into an array at once.
BLOCK = 128


def _bind(value: Column, use) -> Column:
    """use(value), with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _in_blocks(items: Column, step, zero: Column, kind: str, ends) -> Column:
    """Fold ``items`` into an array of ``kind`` by blocks of BLOCK, so that a fold copies a short array only.

    ``step`` folds an item into (pos, out); ``ends`` gives pos after a block from pos before it and the block.
    """
    last = F.greatest(F.floor((F.size(items) - 1) / BLOCK), F.lit(0)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))
    begin = lambda bs: F.aggregate(bs, F.struct(zero.alias("pos"), F.array().cast("array<int>").alias("all")), lambda acc, b: F.struct(ends(acc.pos, b).alias("pos"), F.concat(acc["all"], F.array(acc.pos)).alias("all")))["all"]
    fold = lambda b, pos: F.aggregate(b, F.struct(pos.alias("pos"), F.array().cast(kind).alias("out")), step).out
    return _bind(blocks, lambda bs: F.flatten(F.zip_with(bs, begin(bs), fold)))


def _spans(found: Column, kind: int) -> Column:
    """Spans from gaps and matches: a running sum of lengths."""

    def step(acc, m):
        start = acc.pos + m.gap
        end = start + F.length(m["all"])
        return F.struct(end.alias("pos"), F.concat(acc.out, F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.part.alias("part")))).alias("out"))

    ends = lambda pos, b: pos + F.aggregate(b, F.lit(0), lambda n, m: n + m.gap + F.length(m["all"]))
    return F.when(found.isNull(), F.array().cast(_SPANS)).otherwise(_in_blocks(found, step, F.lit(0), _SPANS, ends))


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named by number, so that no name clashes with one in here, and its own names."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns


def scan_secrets(docs: DataFrame, model: DataFrame | None = None, text_col: str = "text", least: float = MARKOV_LEAST) -> DataFrame:
    """``docs`` with secret_spans, array<struct<start, kind, end>> by start and kind (index in KINDS)."""
    llr = model_literal(train(training_samples(docs.sparkSession)) if model is None else model)
    docs = docs.drop("secret_spans")
    plain, names = _apart(docs)
    text = F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit(""))
    cols = plain.columns
    found = plain.select(*cols, _found(text, ASSIGN, 2).alias("a"), _found(text, ACCESS, 0).alias("k"), _found(text, HEX, 0).alias("h"), _found(text, MARKOV_RUN, 0).alias("m"))
    spans = found.select(
        *cols,
        F.filter(_spans(F.col("a"), 0), lambda s: F.length(s.part) >= ASSIGN_MIN).alias("a"),
        _spans(F.col("k"), 1).alias("k"), _spans(F.col("h"), 2).alias("h"), _spans(F.col("m"), 3).alias("m"),
    )
    mixed = lambda s: F.regexp_like(s.part, F.lit("[0-9]")) & F.regexp_like(s.part, F.lit("[A-Za-z]"))
    extra = F.filter(F.col("m"), lambda s: mixed(s) & ((mean_llr(s.part, llr) >= least) | stretch_reaches(s.part, llr, least)))
    every = F.array_sort(F.concat("a", "k", "h", F.when(F.size("m") > 0, extra).otherwise(F.array().cast(_SPANS))))
    thin = F.transform(every, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    return spans.select(*[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)], thin.alias("secret_spans"))


def _cut(text: Column, start, end=None) -> Column:
    """Code points ``start`` (from 0) up to ``end``, or to the text's end."""
    return F.substring(text, start + 1, F.length(text) if end is None else end - start)


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each span replaced by ``mark``; overlapping spans become one.

    Pieces are cut from the part of the text that a block of spans covers and are joined once.
    """
    merge_zero = F.struct(F.lit(-1).alias("pos"), F.array().cast(_HOLES).alias("out"))

    def merge(acc, s):
        fresh = s.start >= acc.pos
        hole = F.struct(F.when(fresh, s.start).otherwise(acc.pos).alias("start"), F.greatest(acc.pos, s.end).alias("end"), fresh.alias("fresh"))
        return F.struct(F.greatest(acc.pos, s.end).alias("pos"), F.concat(acc.out, F.array(hole)).alias("out"))

    last_end = lambda pos, b: F.greatest(pos, F.array_max(F.transform(b, lambda s: s.end)))
    # a span that begins inside the one before only carries on its hole
    holes = _in_blocks(spans, merge, merge_zero.pos, _HOLES, lambda pos, b: F.coalesce(last_end(pos, b), pos))
    before = lambda hs, i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(hs, F.greatest(i, F.lit(1)))["end"])

    def pieces(b, low, part):
        at = F.concat(F.array(low), F.transform(b, lambda h: h.end))
        return F.array_join(F.zip_with(b, F.slice(at, F.lit(1), F.size(b)), lambda h, e: F.concat(_cut(part, e - low, h.start - low), F.when(h.fresh, F.lit(mark)).otherwise(F.lit("")))), "")

    def block(hs, i):
        b = F.struct(F.slice(hs, i * BLOCK + 1, F.lit(BLOCK)).alias("b"), before(hs, i * BLOCK).alias("low"))
        return _bind(b, lambda x: _bind(_cut(text, x.low, F.element_at(x.b, -1)["end"]), lambda part: pieces(x.b, x.low, part)))

    def whole(hs):
        body = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(hs) - 1) / BLOCK).cast("int")), lambda i: block(hs, i)), "")
        return F.concat(body, _cut(text, F.element_at(hs, -1)["end"]))

    return F.when(F.size(spans) > 0, _bind(holes, whole)).otherwise(text)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", model: DataFrame | None = None) -> DataFrame:
    """``docs`` with each secret span replaced by ``mark``; overlapping spans become one mark.

    ``n_chars``, if there is such a column, is set anew where the text changes.
    """
    plain, names = _apart(docs)
    at = names.index(text_col)
    scanned = scan_secrets(plain, model, f"c{at}")
    hit = F.size("secret_spans") > 0
    out = scanned.withColumn(f"c{at}", redacted(F.col(f"c{at}"), F.col("secret_spans"), mark))
    if "n_chars" in names:
        size = f"c{names.index('n_chars')}"
        out = out.withColumn(size, F.when(hit, F.length(f"c{at}").cast("long")).otherwise(F.col(size)))
    return out.drop("secret_spans").toDF(*names)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s.kind == k)).cast("long")
    base = _joined(F.filter("secret_spans", lambda s: s.kind < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"))
