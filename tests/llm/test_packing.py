from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeloom.llm.packing import TOKENIZER, load_encoder, pack, pack_histogram, packing_report, slots_of


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20), st.integers(1, 7))
def test_histogram_packing_holds_exactly_the_items(counts, tiers):
    patterns = pack_histogram(counts, 64, tiers)
    held = Counter()
    for n, runs in patterns:
        spans = sorted((at + i * k, at + (i + 1) * k) for k, copies, at in runs for i in range(copies))
        assert n > 0 and spans[-1][1] <= 64 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        for k, copies, _ in runs:
            held[k] += n * copies
        for a, z in spans:  # no text crosses the border of a window of its tier
            size = min(x for x in [64 >> t for t in range(tiers)] if x >= z - a)
            while size < 64:
                if a // size == (z - 1) // size:
                    break
                size *= 2
            assert size <= 64
    assert held == Counter(counts)
    slots = slots_of(patterns)
    assert int((slots.n * slots.copies).sum()) == sum(counts.values())


def test_tiers_matter_and_gaps_of_long_windows_are_filled():
    counts = {40: 10, 20: 10, 24: 10, 10: 5}
    four, one = pack_histogram(counts, 64, 4), pack_histogram(counts, 64, 1)
    assert sorted(four) != sorted(one)
    assert any({k for k, _, _ in runs} >= {40, 24} for _, runs in four)  # a shorter tier in a long window's gap
    # windows of 32 stand at whole multiples of their size
    assert {(20, 0), (20, 32)} <= {(k, at) for _, runs in pack_histogram({20: 4}, 64, 2) for k, _, at in runs}


def test_long_empty_null_and_repeated_texts(spark):
    enc = load_encoder(TOKENIZER)
    long = "the kettle sings and the oven hums " * 900
    rows = [(i, f"short text number {i} with a few words" * (1 + i % 40)) for i in range(300)] + [(1000, long), (1001, None), (1002, ""), (1003, "same"), (1004, "same"), (1004, "same")]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, container_id int")
    out = pack(df, "doc_id", "text", capacity=512, step_size=4).collect()
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    assert [r.container_id for r in by_doc[1001] + by_doc[1002]] == [None, None]
    n = len(enc.encode_ordinary(long))
    parts = sorted(by_doc[1000], key=lambda r: r.part)
    assert sum(r.n_tokens for r in parts) == n and all(r.n_tokens == 512 for r in parts[:-1])
    room = defaultdict(list)
    for r in out:
        if r.container_id is not None:
            room[r.container_id].append((r.token_offset, r.n_tokens))
    for spans in room.values():  # pieces do not overlap and fit
        at = 0
        for a, k in sorted(spans):
            assert a >= at
            at = a + k
        assert at <= 512
    for d, text in rows[:300]:
        assert len(by_doc[d]) == 1 or len(enc.encode_ordinary(text)) > 512
    assert len(by_doc[1004]) == 2
    assert sorted((r.doc_id, r.part, r.n_tokens) for r in pack(df, "doc_id", "text", capacity=512, tiers=1, bucket_rows=10).collect()) == sorted((r.doc_id, r.part, r.n_tokens) for r in out)
    rep = packing_report(pack(df, "doc_id", "text", capacity=512, step_size=4), 512).first()
    assert rep.used > 0.9


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("share", [1 / 3])
def test_a_third_of_one_length(spark, share):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'copy of one text' ELSE concat('text ', repeat('word ', cast(id % 97 AS int))) END AS text")
    out = pack(df, "doc_id", "text", capacity=128)
    worst = out.groupBy("container_id").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0]
    assert worst <= 128 and out.where("container_id IS NOT NULL").select("doc_id").distinct().count() == 3000
