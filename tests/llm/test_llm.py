"""Corpus operators against brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyview.llm import avi, bpe, brown, common, components, jaccard, jpeg, langid, media, mixing, multi_index, repeats, secrets, suffix_sort
from polyview.llm.common import crc_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    texts = [None, "", " \n ", "A b", "a  B", "x" * 5000, base[0], base[0], base[0] + " tail one", base[1], "head " + base[1], base[2] + prose(rng, 90), prose(rng, 60) + " " + base[2] + " " + prose(rng, 30)]
    texts += base[3:] + [base[5][:200], 'é token = "abc123def" AKIA' + "B" * 20 + " " + "0f" * 20, "password: secret: abcdef"]
    out = [(i, t, "en" if i % 2 else "xx", [None, "a", "b"][i % 3], len(t or ""), 0, 0.0) for i, t in enumerate(texts)]
    return out + [out[6], (None, "no id", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_brown_counts_and_scores(docs, rows):
    got = brown.fit_and_score(docs, crc_mod(F.col("doc_id"), 7) == 2, chunk_bytes=500, classes=4, passes=2).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r[0]) for w in [*words(r[1]), ""])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        t = [*words(r[1]), ""]
        want[r[0], held(r[0]), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert brown.fit_and_score(docs.limit(0), F.lit(False)).count() == 0
    unknown = brown.fit_and_score(docs, F.lit(True)).collect()
    assert len(unknown) == len(rows) and all(r.n_known == r.train_tokens == r.score == 0 for r in unknown)


def test_brown_scores_against_brute_force(docs, rows):
    """Scores from the learned classes by plain counting, and probabilities that sum to one."""
    k, mix = 5, 0.95
    model = brown.fit(docs, F.col("doc_id") % 3 == 1, classes=k, core=6, chunk_bytes=900, passes=4)
    held = lambda i: i is not None and i % 3 == 1
    texts = [[*words(r[1]), ""] for r in rows]
    count = Counter(w for r, t in zip(rows, texts, strict=True) if not held(r[0]) for w in t)
    found = {bytes(r["word"]).decode(): (r["class"], r["n"]) for r in brown.word_classes(model).collect()}
    assert {w: n for w, (_, n) in found.items()} == dict(count)
    cls = {w: c for w, (c, _) in found.items()}
    tokens, vocabulary, pairs = Counter(), Counter(cls.values()), Counter()
    for r, t in zip(rows, texts, strict=True):
        if not held(r[0]):
            pairs.update((cls[v], cls[w]) for v, w in zip(["", *t], t, strict=False))
    for w, n in count.items():
        tokens[cls[w]] += n
    n, size = sum(count.values()), len(count)
    prior = [(tokens[c] + 1) / (n + k) for c in range(k)]
    after = [sum(pairs[c, d] for d in range(k)) for c in range(k)]

    def probability(v, w):
        move = lambda d: (pairs[cls[v], d] + prior[d]) / (after[cls[v]] + 1) if v in cls else prior[d]
        slots = lambda d: tokens[d] + vocabulary[d] + 1
        p = move(cls[w]) * (count[w] + 1) / slots(cls[w]) if w in cls else sum(move(d) / slots(d) for d in range(k))
        return mix * p + (1 - mix) * (count[w] + 1) / (n + size + 1)

    for v in ["", "a", "never seen", *list(cls)[:3]]:
        assert np.isclose(sum(probability(v, w) for w in [*cls, "never seen"]), 1)
    want = Counter((r[0], round(sum(math.log10(probability(v, w)) for v, w in zip(["", *t], t, strict=False)), 6)) for r, t in zip(rows, texts, strict=True))
    assert Counter((r.doc_id, round(r.score, 6)) for r in brown.score(model).collect()) == want


def test_exchange_finds_alternating_classes():
    rng, pairs = np.random.default_rng(0), np.zeros((9, 9))
    pairs[:4, 4:8], pairs[4:8, :4] = rng.integers(5, 30, (4, 4)), rng.integers(5, 30, (4, 4))  # words 0-3 stand next to words 4-7 only
    at = brown.exchange(pairs, 2)
    assert len(set(at[:4])) == 1 and len(set(at[4:])) == 1 and at[0] != at[4]


@pytest.mark.parametrize("seed", range(8))
def test_exchange_ends_in_a_local_optimum(seed):
    rng = np.random.default_rng(seed)
    pairs = rng.poisson(3, (13, 13)) * rng.integers(0, 5, (13, 13))

    def likelihood(at):
        member = np.eye(4)[[*at, 3]]
        t = member.T @ pairs @ member
        return brown._xlogx(t).sum() - brown._xlogx(t.sum(0)).sum() - brown._xlogx(t.sum(1)).sum()

    at = brown.exchange(pairs, 3, sweeps=50)
    assert likelihood(at) > likelihood(np.arange(12) % 3)
    for w in range(12):
        for c in range(3):
            assert likelihood([*at[:w], c, *at[w + 1 :]]) <= likelihood(at) + 1e-6


def test_gains_of_all_words_against_brute_force():
    rng = np.random.default_rng(3)
    pairs, at = rng.poisson(0.4, (30, 30)).astype(float), rng.integers(0, 4, 30)
    table = lambda at: np.eye(4)[at].T @ pairs @ np.eye(4)[at]
    sides = pairs @ np.eye(4)[at], pairs.T @ np.eye(4)[at], np.diag(pairs)
    got = brown.Gains(table(at)).exact(at, *sides)
    now = brown.likelihood(table(at))
    for w in range(30):
        want = [brown.likelihood(table(np.array([*at[:w], c, *at[w + 1 :]]))) - now for c in range(4)]
        assert np.allclose(got[w] - got[w, at[w]], want)


def test_gains_of_rare_words_and_large_counts():
    rng = np.random.default_rng(4)
    pairs = rng.poisson(20000, (12, 12)).astype(float)
    pairs[8:] = pairs[:, 8:] = 0
    pairs[8, :4], pairs[:4, 8], pairs[9, 2], pairs[5, 9] = [1, 0, 2, 1], [2, 1, 1, 0], 1, 1  # two rare words among common ones
    at = np.arange(12) % 4
    member = np.eye(4, dtype=int)[at]
    gains = brown.Gains(member.T @ pairs @ member)
    sides = (pairs @ member).astype(int), (pairs.T @ member).astype(int), np.diag(pairs).astype(int)
    exact = gains.exact(at, *sides)
    rare = gains.rare(at[8:10], *(x[8:10] for x in sides))
    change = lambda g, at: g - g[np.arange(len(g)), at][:, None]
    assert np.allclose(change(rare, at[8:10]), change(exact[8:10], at[8:10]), atol=0.01)
    assert gains.once()[at[9], at[2], at[5]] == (exact[9].argmax() if exact[9].max() > exact[9, at[9]] else at[9])
    for w in range(8):
        for c in range(4):
            moved = np.eye(4)[[*at[:w], c, *at[w + 1 :]]]
            want = brown.likelihood(moved.T @ pairs @ moved) - brown.likelihood(gains.table)
            assert np.isclose(change(exact, at)[w, c], want, rtol=1e-4, atol=0.1)


def test_frequent_counts_are_not_clipped():
    big = np.array([3, 2**40 + 7, 0])
    assert bpe.unpack_longs(bpe.pack_longs(big)).tolist() == big.tolist()


def test_shared_folder_on_a_cluster():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_words_outside_the_core_are_exchanged_too(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"{'ab'[i % 2]}{rng.randrange(50)}" for i in range(200))
    df = spark.createDataFrame([(i, text()) for i in range(60)], "doc_id long, text string")
    got = brown.fit_and_score(df, F.col("doc_id") % 4 == 0, classes=4, core=2, passes=8).where("held_out").collect()
    assert np.mean([r.perplexity for r in got]) < 65  # 50 words may follow; with one class for all, 100 may


def brute_groups(rows, n=4, percent=85):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        k = find(i)
        if r[0] is not None:
            least[k] = r[0] if least[k] is None else min(least[k], r[0])
    return Counter((r[0], len(sets[i]), least[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_groups(docs, rows, n, percent):
    got = jaccard.join_groups(docs, n=n, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, n, percent)
    assert jaccard.join_groups(docs.limit(0)).count() == 0


def test_jaccard_counts_every_document(spark):
    often, seldom = "these four words often", "those four words seldom"
    texts = [often] * jaccard.SKETCH_LEAST + [seldom] * (jaccard.SKETCH_LEAST - 1)
    df = spark.createDataFrame([(f"{t} {i} {i}a {i}b",) for i, t in enumerate(texts)], "text string").repartition(5)
    found = jaccard.frequent_sketch(df, "text", 4, 16)
    at = [tuple(int(x[0]) for x in jaccard._split(jaccard.ngrams([t], 4)[1], 16)) for t in (often, seldom)]
    assert [bool(found[i]) for i in at] == [True, False] and found.sum() == 1


def test_jaccard_word_hashes(spark):
    words = ["", "a", "aa", "b", "a\0", "12345678", "123456789", "x" * 300, "x" * 301, "ä" * 9, *(str(i) for i in range(10_000))]
    got = jaccard.word_hashes(pa.array(words, pa.string()))
    assert len(set(got.tolist())) == len(words)
    assert (jaccard.word_hashes(pa.array(words[::-1], pa.string()))[::-1] == got).all()
    assert (jaccard.word_hashes(pa.array(words, pa.string())[3:]) == got[3:]).all() and not len(jaccard.word_hashes(pa.array([], pa.string())))


def test_jaccard_large_group_in_blocks(spark):
    rng = random.Random(1)
    base = prose(rng, 150).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join_groups(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)
    texts = df.select(F.col("doc_id").alias("cid"), "text")
    links = jaccard.block_links(texts.select(F.lit("k").alias("key"), "cid"), texts, 4, 85, 4, block=32)
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert all(roots.get(r.doc_id, r.doc_id) == r.component_id for r in got)


def test_keep_one(docs, rows):
    kept = jaccard.keep_one(docs).collect()
    assert Counter(r.doc_id for r in kept if not words(r.text)) == Counter(r[0] for r in rows if not words(r[1]))
    assert Counter(r.doc_id for r in kept if words(r.text)) == Counter({c for _, n, c in brute_groups(rows) if n})


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7), (200, None)], "a long, b long")
    assert {r.node: r.root for r in components.components(edges).collect()} == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_media_round_trip(docs, rows):
    q = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    got = media.read_media(media.store_media(q)).collect()
    assert Counter((r.id, bytes(r.payload)) for r in got) == Counter((r[0], media.padded((r[1] or "").encode())) for r in rows)
    assert media.clip_rows(media.read_media(media.store_media(q.limit(2)))).count() >= 2
    assert media.store_media(q.limit(0)).count() == 0


def test_jpeg_general_decoders():
    rng = np.random.default_rng(0)
    lines = rng.integers(0, 256, (5, 64)).astype(np.uint8)
    frame = jpeg.encode_frames(lines, 8)[0]
    assert (jpeg._lossless(jpeg.parse(frame)) == lines).all() and (jpeg.decode_frames([frame])[0] == lines).all()
    assert sorted(jpeg.ZIGZAG.tolist()) == list(range(64)) and jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]
    # a baseline frame of one block: DC difference 40 of a table with one code, then end of block
    seg = jpeg._segment
    dht = seg(0xC4, bytes([0, 0, 1, *[0] * 14, 6])) + seg(0xC4, bytes([0x10, 0, 1, *[0] * 14, 0]))
    bits = "00" + format(40, "06b") + "00" + "111111"
    data = int(bits, 2).to_bytes(2, "big")
    head = b"\xff\xd8" + seg(0xDB, bytes([0] + [8] * 64)) + dht + seg(0xC0, b"\x08\x00\x08\x00\x08\x01\x01\x11\x00") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    assert (jpeg.decode_frames([head + data + b"\xff\xd9"])[0] == 128 + 40).all()


def test_shots_at_a_change_of_scene():
    hist = np.zeros((20, 16))
    hist[:9, 2], hist[9:, 12] = 1, 1
    assert avi.shots(hist) == [(0, 9), (9, 20)]
    assert avi.shots(hist[:1]) == [(0, 1)] and avi.shots(hist[:0]) == []


def plain_clips(payload, rows=16, width=64, radius=4):
    """Clips of a payload by loops over its grey frames: (first frame, frames, mean level)."""
    frames = [payload[i : i + rows * width] for i in range(0, len(payload), rows * width)]
    hist = [[sum(1 for x in f if x // 16 == b) / len(f) for b in range(16)] for f in frames]
    d = [sum(abs(x - y) for x, y in zip(a, b, strict=True)) for a, b in zip(hist, hist[1:], strict=False)]
    cuts = [0]
    for i, x in enumerate(d):
        near = [d[j] for j in range(max(0, i - radius), min(len(d), i + radius + 1)) if j != i]
        mean = sum(near) / max(len(near), 1)
        dev = math.sqrt(max(sum(v * v for v in near) / max(len(near), 1) - mean * mean, 0))
        if x >= 0.3 and x > mean + 2 * dev and x >= (d[i - 1] if i else 0) and x > (d[i + 1] if i + 1 < len(d) else 0):
            cuts.append(i + 1)
    cuts.append(len(frames))
    level = lambda h: sum(v * (16 * b + 8) for b, v in enumerate(h))
    return [(a, b - a, sum(map(level, hist[a:b])) / (b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def test_clips_against_plain_loops(spark):
    rng = random.Random(7)
    scene = lambda n: bytes(rng.choice(rng.choice([b"aeiou nrst", b"0123456789", b"ABCDEF{}~"])) if rng.random() < 0.02 else c for c in bytes(rng.choice(b"\x20\x61\x30\xc3") for _ in range(1)) * n)
    payloads = [b"".join(scene(rng.randint(500, 9000)) for _ in range(rng.randint(1, 9))) for _ in range(25)] + [b"", b"x"]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "id int, payload binary")
    got = defaultdict(list)
    for r in media.clip_rows(media.read_media(media.store_media(df))).orderBy("id", "clip").collect():
        assert (r.start_ms, r.end_ms) == (r.first_frame * 40, (r.first_frame + r.frames) * 40)
        got[r.id].append((r.first_frame, r.frames, r.level))
    for i, p in enumerate(payloads):
        want = plain_clips(media.padded(p))
        assert [x[:2] for x in got[i]] == [x[:2] for x in want] and np.allclose([x[2] for x in got[i]], [x[2] for x in want], atol=1e-3)
    assert any(len(x) > 2 for x in got.values())


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_spans(spark, docs, rows):
    got = secrets.scan_secrets(docs).select("text", "secret_spans").collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r.secret_spans if s.kind < 3] == base_spans(r.text)
    q = spark.createDataFrame([("use ghp_16C7e42F292c6912E7710c838347Ae178B4a ok",), ("a calculate_total_amount_2021_v2 b",), ("Donaudampfschifffahrtsgesellschaft",)], "text string")
    found = [[s.kind for s in r.secret_spans] for r in secrets.scan_secrets(q).collect()]
    assert found == [[3], [], []]
    red = [r.text for r in secrets.redact_secrets(q).collect()]
    assert red[0] == "use [SECRET] ok" and red[1] == "a calculate_total_amount_2021_v2 b"
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_secret_spans_against_an_independent_ratio(spark):
    """Markov spans by plain counting over the labelled samples."""
    size, pairs, firsts = len(secrets.ALPHABET), Counter(), Counter()
    for r in secrets.training_samples(spark).collect():
        for a, b in zip(r.text, r.text[1:], strict=False):
            if a in secrets.ALPHABET and b in secrets.ALPHABET:
                pairs[r.label, a, b] += 1
                firsts[r.label, a] += 1
    logp = lambda k, a, b: math.log((pairs[k, a, b] + 1) / (firsts[k, a] + size))
    total = lambda x: sum(logp(1, a, b) - logp(0, a, b) for a, b in zip(x, x[1:], strict=False))

    def is_secret(run):
        if not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
            return False
        parts = [p for p in re.split("[=/_-]+", run) if p]
        stretches = [parts[i:j] for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)]
        return total(run) / (len(run) - 1) >= secrets.MARKOV_LEAST or any(len("-".join(x)) >= secrets.MARKOV_MIN and sum(map(total, x)) >= secrets.MARKOV_LEAST * sum(map(len, x)) for x in stretches)

    rng = random.Random(11)
    names, chars = secrets.PARTS, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(chars) for _ in range(n))
    texts = [" ".join(rng.choice([f"{rng.choice(names)}_{rng.choice(names)}_{rng.randint(1, 2030)}", key(rng.randint(12, 40)), f"{rng.choice(names)}/{key(22)}", "token=" + key(24), "AKIA" + key(20).upper(), rng.choice(names)]) for _ in range(rng.choice([1, 5, 400]))) for _ in range(40)]
    texts[0] = texts[0] + " é " * 50 + "token=abcdef " * 700  # more matches than a block holds
    df = spark.createDataFrame([(i, t, "a", "k", 0) for i, t in enumerate(texts)], "c1 long, text string, a string, secret_spans string, __a int")
    hits = 0
    for r in secrets.scan_secrets(df).collect():
        want = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", r.text) if is_secret(m[0])]
        assert [tuple(s) for s in r.secret_spans] == sorted(base_spans(r.text) + want)
        hits += len(want)
    assert hits > 1000
    spans = {r.c1: [(s.start, s.end) for s in r.secret_spans] for r in secrets.scan_secrets(df).collect()}
    red = secrets.redact_secrets(df)
    assert red.columns == df.columns
    for r in red.collect():
        out, pos = [], 0
        for a, b in spans[r.c1]:
            if a >= pos:
                out.append(texts[r.c1][pos:a] + "[SECRET]")
            pos = max(pos, b)
        assert r.text == "".join(out) + texts[r.c1][pos:] and (r.a, r.secret_spans, r["__a"]) == ("a", "k", 0)


def test_secret_keys_glued_to_names(spark):
    rng = random.Random(4)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = ["{}", "my_service_account_key={}", "config/production/service/account/{}", "aws_secret_access_key={}", "{}/production-service-account", "my-production-service-{}-backup-folder"]
    rows = [(f, f.format("".join(rng.choice(alnum) for _ in range(24)))) for f in forms for _ in range(200)]
    rows += [("example", "aws_secret_access_key=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"), ("none", "=/_-" * 8), ("none", "a-1/" * 3000), ("none", "backup/network/certificate/customer/v2"), ("none", "employee_salary_report_v12_final_version")]
    found, size = Counter(), Counter(f for f, _ in rows)
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "form string, text string")).collect():
        found[r.form] += [tuple(s) for s in r.secret_spans] == [(0, 3, len(r.text))]
    assert all(found[f] >= 0.95 * size[f] for f in [*forms, "example"]) and not found["none"]


def test_bpe_round_trip(docs, rows):
    import tiktoken

    ranks, pattern = bpe.vocabulary()
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, ranks, pattern, chunk_bytes=700), ranks).collect()
    assert Counter((r.doc_id, tuple(r.tokens), bytes(r.decoded)) for r in got) == Counter((r[0], tuple(enc.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    d = bpe.digests(docs, ranks, pattern).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in d) == Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert bpe.digests(docs.limit(0), ranks, pattern).count() == 0


def test_language_id(spark, docs):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30, "abcdefg" if i % 2 else "nopqrst"), "l1" if i % 2 else "l2") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 100"), steps=40)
    out = langid.predict(df, model, keep=["lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in out if r.doc_id >= 100]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    odd = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert odd[0] == odd[1] == odd[2] == "und"
    assert langid.label_bytes(model, b"abc" * 50).shape == (150, 2)
    assert langid.fit(docs.limit(0)) is None and langid.predict(docs, None).where("lang_pred != 'und'").count() == 0


def plain_gru(m, data, size=64):
    """Pooled probabilities of a text, one byte after another."""
    h, out = m.rec.shape[2], np.zeros(len(m.langs))
    sigmoid2 = lambda v: (1 + np.tanh(v)) / 2
    for at in range(0, len(data), size):
        window, states = data[at : at + size], []
        for d in (0, 1):
            now, own = np.zeros(h), {}
            for t in range(len(window)) if d == 0 else reversed(range(len(window))):
                a, u = m.emb[d][window[t]].astype(float), m.rec[d].astype(float) @ now
                z, r = sigmoid2(a[:h] + u[:h]), sigmoid2(a[h : 2 * h] + u[h : 2 * h])
                c = np.tanh(a[2 * h :] + r * (u[2 * h :] + m.bias[d][:, 0]))
                now = z * now + (1 - z) * c
                own[t] = now
            states.append(own)
        for t in range(len(window)):
            x = m.out.astype(float) @ np.concatenate([states[0][t], states[1][t]]) + m.off[:, 0]
            e = np.exp(x - x.max())
            out += e / e.sum()
    return out / max(len(data), 1)


def test_gru_pools_as_a_plain_loop():
    rng = np.random.default_rng(1)
    m = langid.BiGRU.start(["a", "b", "c"], 5, rng)
    m.bias += 0.3
    # the padding of a last window is input of its backward states, so the plain loop takes whole windows
    texts = [b"x", bytes(rng.integers(0, 256, 63).astype(np.uint8)), bytes(rng.integers(0, 256, 200).astype(np.uint8)), b"", "čeština a němčina".encode() * 9]
    got = langid.pool(m, texts, width=2)
    for t, p in zip(texts, got, strict=True):
        whole = len(t) // 64 * 64
        if whole:
            assert np.allclose(langid.label_bytes(m, t)[:whole].mean(0), plain_gru(m, t[:whole]), atol=1e-4)
        assert np.allclose(p, langid.label_bytes(m, t).mean(0) if t else 0, atol=1e-5)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    m = langid.BiGRU.start(["a", "b", "c"], 4, rng)
    for name in ("emb", "rec", "bias", "out", "off"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    x = np.full((7, 5), langid.PAD)
    x[:5] = rng.integers(0, 256, (5, 5))
    y = rng.integers(0, 3, 5)
    _, grads = langid.gradients(m, x, y)
    for p, g in zip(m.params, grads, strict=True):
        i = int(np.abs(g).argmax())
        old = p.flat[i]
        p.flat[i] = old + 1e-2
        up = langid.gradients(m, x, y)[0]
        p.flat[i] = old - 1e-2
        down = langid.gradients(m, x, y)[0]
        p.flat[i] = old
        assert np.isclose((up - down) / 2e-2, g.flat[i], rtol=1e-2)


def test_multi_index(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 8))
    x[7], x[9] = x[0], x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (650, [0.0] * 8), (700, [float("nan")] * 8), (None, [1.0] * 8), (750, [1.0])]
    got = multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, part=40).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        s = unit @ unit[q]
        s[q] = -9
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and np.allclose([s[r.vec_id] for r in own], [r.score for r in own])
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(600), -s))[:5]))
    assert hits / 60 >= 0.9 and {r.query_id for r in got} == set(range(0, 600, 50))
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)][:2] == [7, 9]


def test_share_follows_the_data():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = rng.standard_normal((200, 16))
    for x, most, least in ((unit(centres[rng.integers(0, 200, 4000)] + 0.05 * rng.standard_normal((4000, 16))), 0.05, 0), (unit(rng.standard_normal((4000, 64))), 1, 0.3)):
        books = multi_index.kmeans(x[:, : x.shape[1] // 2], 32), multi_index.kmeans(x[:, x.shape[1] // 2 :], 32)
        assert least <= multi_index.share_for(x, books, 5, 0.95) <= most
    start, pieces = multi_index.deal_cells(np.array([3, 4, 9, 0, 25, 1, 10]), 10)
    assert start.tolist() == [0, 0, 1, 1, 2, 5, 6] and pieces.tolist() == [1, 1, 1, 1, 3, 1, 1]
    assert [multi_index.codebook_size(n) for n in (0, 500, 51_000, 10**9)] == [16, 16, 64, 256]


def test_multi_index_repeated_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 4))
    ids = np.arange(80) // 2 * 5  # every id twice, with different vectors
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in multi_index.search(df.union(df), F.col("id") % 50 == 0, share=1.0, part=20).collect()}
    want = {}
    for q in range(0, 200, 50):
        best = {int(i): round(float((unit[ids == q] @ unit[ids == i].T).max()), 9) for i in set(ids) if i != q}
        want |= {(q, k): x for k, x in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5], 1)}
    assert got == want


def test_mixing(spark, docs, rows):
    got = mixing.mix_sources(docs).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
    assert np.isclose(sum(target.values()), sum(size.values()))
    assert all(taken[s] == math.floor(target[s]) for s in size) and len(got) == len(rows)
    mixed = mixing.apply_mix(docs).collect()
    assert sum(len(words(r.text)) for r in mixed) == sum(taken.values())
    skewed = spark.createDataFrame([(1, "a b", "s"), (2, prose(random.Random(0), 100), "t")], "doc_id long, text string, source string")
    assert {r.source: r.target for r in mixing.mix_sources(skewed).collect()} == {"s": 6.0, "t": 96.0}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_columns_that_clash(spark, rows):
    """Further columns named like the operators' own stay as they are."""
    names = ["__key", "__a", "mix_key", "root", "key", "id", "secret_spans", "c0", "mix_turn", "__id"]
    df = spark.createDataFrame([(*r[:5], *[f"{n} {i}" for n in names]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for stage in (jaccard.keep_one, mixing.apply_mix, secrets.redact_secrets):
        out = stage(df)
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[n].startswith(f"{n} ") for r in got for n in names)


def test_suffix_sorting():
    rng = random.Random(1)
    for _ in range(200):
        s = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 30))]
        order = suffix_sort.deep_shallow(s, 0, rng.choice([0, 2, 4]))
        assert sorted(order) == list(range(len(s))) and [s[i] for i in order] == sorted(s)


def test_matches_against_all_pairs():
    rng = random.Random(3)
    for _ in range(60):
        m = rng.randint(2, 12)
        left, right = ([bytes(rng.choice(b"aab") for _ in range(rng.randint(0, 8))) for _ in range(m)] for _ in range(2))
        got = suffix_sort.matches(left, right, 5)
        for i in range(m):
            cover = lambda pairs: {x for a, b in pairs if a + b >= 5 for x in range(-a, b)}
            assert cover(got[i]) == cover((suffix_sort.lcp(left[i], left[j]), suffix_sort.lcp(right[i], right[j])) for j in range(m) if j != i)


def test_anchors_of_texts_longer_than_a_piece(monkeypatch):
    rng = random.Random(6)
    data = bytes(rng.choice(b"abc ") for _ in range(5000)) * 2
    whole = repeats.anchors(data, 400, repeats.Powers())
    monkeypatch.setattr(repeats, "PIECE", 700)
    parts = repeats.anchors(data, 400, repeats.Powers())
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert (np.diff(whole[0]) <= 400 - repeats.K + 1).all()


@pytest.mark.parametrize("length", [40, 400])
def test_repeats(docs, rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    want = Counter()
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        want[r[0], len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), kept] += 1
    got = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(docs, length=length).collect())
    assert got == want
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    more = [(1000 + i, prose(rng, 40, "abcdefg" if i % 2 else "nopqrst"), "l1" if i % 2 else "l2", "a", 1, 0, 0.0) for i in range(60)]
    more.append((2000, more[0][1], "l2", "a", 1, 0, 0.0))
    spark.createDataFrame(rows + more, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "score"]
    assert {r.doc_id for r in kept["language ID"]} >= {1000 + i for i in range(60)} and not {0, 1, 2} & {r.doc_id for r in kept["language ID"]}
    one = kept["n-gram Jaccard join"]
    assert sorted({r.doc_id for r in one if (r.doc_id or 0) >= 1000}) == [1000 + i for i in range(60)] and len({r.text for r in one}) == len(one)
    assert len(kept["secret scans"]) == len(one) and any("[SECRET]" in r.text for r in kept["secret scans"])
    total = sum(len(words(r.text)) for r in kept["secret scans"])
    assert abs(sum(len(words(r.text)) for r in kept["source mixing"]) - total) <= 4
    got = Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == plain_pipeline(spark, rows + more)


def plain_pipeline(spark, rows):
    """What run() returns, by plain loops; the language model and the Markov ratios are those of the stages."""
    import tiktoken

    learn = langid.learnable(spark.createDataFrame(rows, SCHEMA))
    model, letter = langid.fit(learn), re.compile(r"[^\W\d_]")
    left = [r for r in rows if r[1] and letter.search(r[1]) and langid.label_bytes(model, r[1].encode()).mean(0).max() >= 0.3]
    groups, one = defaultdict(list), []
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) for w in (words(r[1]) for r in left)]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if words(left[i][1]) and words(left[j][1]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    for i, r in enumerate(left):
        groups[root[i]].append(r)
    for members in groups.values():
        if words(members[0][1]):
            one.append(min(members, key=lambda r: (r[0] is None, r[0] or 0)))
        else:
            one += members
    found = {(r.doc_id, r.text): r.secret_spans for r in secrets.scan_secrets(spark.createDataFrame(one, SCHEMA)).collect()}
    clean = []
    for r in one:
        out, pos = [], 0
        for s in found[r[0], r[1]]:
            if s.start >= pos:
                out.append(r[1][pos : s.start] + "[SECRET]")
            pos = max(pos, s.end)
        clean.append((r[0], "".join(out) + r[1][pos:], r[3]))
    size = Counter()
    for _, text, source in clean:
        size[source] += len(words(text))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(size.values())
    while True:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * size[s] < level * weight[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * size[s]
            rest -= target[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    mixed = []
    for s in names:
        docs = sorted(((hashlib.md5(f"7|{'' if i is None else i}|{t}".encode()).hexdigest(), i, t) for i, t, x in clean if x == s))
        budget = math.floor(target[s])
        while budget > 0:
            for _, i, t in docs:
                n = min(len(words(t)), budget)
                if n:
                    ends = [m.end() for m in WORD.finditer(t)]
                    mixed.append((i, t if n == len(ends) else t[: ends[n - 1]]))
                budget -= n
    ranks, pattern = bpe.vocabulary()
    enc = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for i, t in mixed:
        ids = enc.encode_ordinary(t)
        out[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_one_language_and_nulls(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(random.Random(i), 30), "l1", None, None, 0, 0.0) for i in range(6)] + [(9, None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(6))


def test_pipeline_counts_ngrams_of_every_document(spark, monkeypatch):
    import corpus_pipeline

    rng, often, seldom = random.Random(5), "these five words come often", "those five words come seldom"
    base = prose(rng, 60)
    texts = [often] * jaccard.SKETCH_LEAST + [seldom] * (jaccard.SKETCH_LEAST - 1)
    rows = [(i, f"{t} {i} {prose(rng, 12)}") for i, t in enumerate(texts)] + [(1000 + i, f"{often} {base} {i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    sketches, of = [], jaccard.frequent_sketch
    monkeypatch.setattr(jaccard, "frequent_sketch", lambda *args: sketches.append(of(*args)) or sketches[-1])
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, df, None).collect()}
    assert kept == {r[0] for r in rows} - {1001, 1002, 1003}
    at = [tuple(int(x[0]) for x in jaccard._split(jaccard.ngrams([t], 5)[1], len(sketches[0]))) for t in (often, seldom)]
    assert [bool(sketches[0][i]) for i in at] == [True, False]
    # the sketch decides the order only: without it, or with every n-gram frequent, the same documents stay
    for value in (False, True):
        monkeypatch.setattr(jaccard, "frequent_sketch", lambda *args, value=value: np.full(sketches[0].shape, value))
        assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, df, None).collect()} == kept
