import random

import numpy as np

from placeloom.llm.leakage import leaks, stretch, words

ITEMS = [
    (1, "The market hall of Grenne opened in 1804 beside the amber canal. Every ounce of plums was weighed against old stones. The guild kept ninety ovens and one master who never slept before dawn came."),
    (2, "Short question about seven brass kettles and their owner."),
    (3, None), (4, ""), (5, "two words"),
]


def run(spark, docs):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    return {(r.doc_id, r.item_id) for r in leaks(d, "doc_id", "text", spark.createDataFrame(ITEMS, "item_id long, text string"), "item_id", "text").collect()}


def test_whole_edited_marked_up_and_short_quotes(spark):
    whole = ITEMS[0][1]
    w = whole.split()
    edited = " ".join(x if k % 13 else "wholly" for k, x in enumerate(w, 1))
    split = ". ".join(s + ". Ask for the corner by the window if you want a loud evening" for s in whole.split(". "))
    docs = [(10, "Before. " + whole.upper() + " After."), (11, edited), (12, "<p>" + whole.replace("amber", "<b>amber</b>") + "</p>"), (13, split), (14, " ".join(w[5:25])), (15, " ".join(w[3:12])), (16, None), (17, ""), (18, "Nothing here at all. " * 2000 + whole), (18, whole), (19, ITEMS[1][1]), (20, "zero​width " + whole.replace("canal", "can­al"))]
    assert run(spark, docs) == {(i, 1) for i in (10, 11, 12, 13, 14, 18, 20)} | {(19, 2)}


def test_other_passage_of_the_style(spark):
    assert run(spark, [(1, "The market hall of Dorra opened in 1622 beside the narrow canal. Every sack of oats was weighed against new stones. The guild kept forty ovens and one master who never spoke before noon came.")]) == set()


def test_empty(spark):
    assert run(spark, []) == set()


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    docs = []
    for d in range(120):
        body = [rng.choice(vocab) for _ in range(80)]
        if d % 3 == 0:
            w = words(ITEMS[0][1])
            n = rng.randrange(5, len(w))
            a = rng.randrange(0, len(w) - n + 1)
            at = rng.randrange(0, 80)
            body[at:at] = w[a : a + n]
        docs.append((d, " ".join(body)))
    item = words(ITEMS[0][1])
    need = max(15, -(-len(item) // 3))
    want = set()
    for d, t in docs:
        x = words(t)
        cover = [False] * len(item)
        for p in range(len(item) - 4):
            if any(x[q : q + 5] == item[p : p + 5] for q in range(len(x) - 4)):
                for j in range(5):
                    cover[p + j] = True
        if any(sum(cover[a:b]) >= 0.8 * (b - a) for a in range(len(item)) for b in range(a + need, len(item) + 1)):
            want.add((d, 1))
    assert run(spark, docs) == want


def test_stretch_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 40)
        covered, stock, need = np.array([rng.random() < 0.7 for _ in range(n)]), np.array([rng.random() < 0.2 for _ in range(n)]), rng.randrange(1, 20)
        own = covered & ~stock
        want = max((int(own[a:b].sum()) for a in range(n) for b in range(a + 1, n + 1) if (~stock[a:b]).sum() >= need and own[a:b].sum() - 0.8 * (~stock[a:b]).sum() > -1e-9), default=0)
        assert stretch(covered, stock, need, 0.8) == want
    assert stretch(np.ones(200_000, bool), np.zeros(200_000, bool), 1000, 0.8) == 200_000  # linear in the item


def test_sentences_far_apart_and_any_bitmap(spark):
    w = ITEMS[0][1].split()
    filler = lambda n, tag: " ".join(f"{tag}{k}" for k in range(n))
    docs = [(1, f"{' '.join(w[:12])} {filler(5000, 'a')} {' '.join(w[12:])}"), (2, f"{' '.join(w[:12])} {filler(40, 'b')} {' '.join(w[:10])} {filler(240, 'c')} {' '.join(w[10:20])}")]
    assert run(spark, docs) == {(1, 1), (2, 1)}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    small = {(r.doc_id, r.item_id) for r in leaks(d, "doc_id", "text", items, "item_id", "text", bits=8).collect()}
    assert small == {(1, 1), (2, 1)}


def test_stock_sentences_count_over_all_items(spark):
    stock = "Read the passage below and answer every one of the questions that follow it in your own plain words please."
    own = ["ovens and millers kept their barley dry through seven wet winters near the northern quay of town", "a ferry of cedar planks crossed the strait each dawn carrying salt wool and forty quiet pilgrims", "the lamp keeper counted ships by their bells and wrote each number on a slate beside the stair"]
    items = spark.createDataFrame([(i, f"{stock} {x}.") for i, x in enumerate(own)], "item_id long, text string")
    d = spark.createDataFrame([(1, stock), (2, own[0]), (3, f"{stock} {own[2]}")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(d, "doc_id", "text", items, "item_id", "text").collect()} == {(2, 0), (3, 2)}
