"""The length histogram against the tokenizer library and plain counting."""

import random

import pytest
import tiktoken

from polyview.llm import bpe, token_counts


@pytest.mark.parametrize("block", [3, 4096])
def test_histogram(spark, block):
    rng = random.Random(3)
    texts = [None, "", " ", "a b c", "a b c", "hello world " * 30, "x" * 5000, "é" * 70]
    texts += ["".join(rng.choice("abc de\n9.é") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    ranks, pattern = bpe.vocabulary()
    enc = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = [(i, len(enc.encode_ordinary(t or ""))) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, docs long, block long")
    lengths = token_counts.encoded_lengths(df, ranks, pattern)
    assert sorted(tuple(r) for r in lengths.collect()) == want
    own = [n for _, n in want]
    histogram = token_counts.length_histogram(lengths, block=block)
    got = histogram.collect()
    assert sorted(r.n_tokens for r in got) == sorted(set(own))
    for r in got:
        assert r.docs == own.count(r.n_tokens) and r.total_tokens == sum(own) and r.docs_from == sum(n >= r.n_tokens for n in own)
        assert r.tokens_from == sum(n for n in own if n >= r.n_tokens)
        assert r.truncated_tokens == sum(min(n, r.n_tokens) for n in own) and r.quantile == sum(n <= r.n_tokens for n in own) / len(own)
    assert token_counts.truncated_totals(histogram, [0, 2, 77, 10**6]) == {x: sum(min(n, x) for n in own) for x in (0, 2, 77, 10**6)}
    least = lambda q: min(n for n in own if sum(m <= n for m in own) >= q * len(own))
    assert token_counts.quantiles(histogram, [0.0, 0.25, 0.5, 1.0]) == {q: least(q) for q in (0.0, 0.25, 0.5, 1.0)}


def test_empty_table(spark):
    histogram = token_counts.length_histogram(spark.createDataFrame([], "n_tokens long"))
    assert histogram.count() == 0
    assert token_counts.truncated_totals(histogram, [5]) == {5: 0} and token_counts.quantiles(histogram, [0.5]) == {0.5: None}
