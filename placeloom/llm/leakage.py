"""Evaluation texts leaking into training text.

A prefix-filtered set join on five-word shingles. One pass reads each document once, whole, and keeps the places
where it may hold a shingle of some item, by a bitmap of fixed size whatever the number of items. Shingles are ordered by
rarity, counted over all documents. A document that holds enough of an item must hold one of the item's rarest
shingles, the prefix: documents and items are joined on prefix shingles only, pairs are dropped by length and by
position in that order, and the rest are verified exactly: some window of the item, of the size that counts, must be
covered to four fifths by shingles of the document. Items, shingles and pairs stay tables throughout.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeloom.session import broadcast_if_small, materialize

SHINGLE = 5
INVISIBLE = re.compile("[­​-‏⁠﻿‪-‮]")
MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&[a-zA-Z]+;|&#\d+;")
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text without markup, invisible characters, case and compatibility forms."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return WORD.findall(text.casefold())


class Hashes(dict):
    """Numbers of words, each worked out once."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(nums: np.ndarray) -> np.ndarray:
    """One number for each run of ``SHINGLE`` words."""
    n = len(nums) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h = (h ^ nums[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def sentences(text: str) -> list[list[str]]:
    return [w for x in re.split(r"(?<=[.!?:])\s+", text) if (w := words(x))]


def stretch(covered: np.ndarray, stock: np.ndarray, need: int, dense: float) -> int:
    """Most covered words in any window of an item that has ``need`` words and is covered to ``dense``; 0 if none is.

    Stock words neither count for nor against. For each end the earliest start that is dense enough is the best one.
    """
    covered = covered & ~stock
    gain = np.concatenate([[0.0], np.cumsum(np.where(stock, 0.0, covered - dense))])
    size, own = np.concatenate([[0], np.cumsum(~stock)]), np.concatenate([[0], np.cumsum(covered)])
    least = np.minimum.accumulate(gain)
    a = np.minimum(np.searchsorted(-least, -(gain + 1e-9)), np.arange(len(gain)))
    ok = size - size[a] >= need
    return int(np.where(ok, own - own[a], 0).max(initial=0))


def indexed(items: DataFrame, item_id: str, item_text: str, share: float, least_words: int, dense: float, least: int = 3) -> DataFrame:
    """(i, k, n, h, p, stock, need, needed): a row per distinct item and text.

    ``h`` and ``p`` are its shingles and where they stand, without those inside stock sentences (``stock``: their words, from
    and to), which at least ``least`` of all texts hold word for word. ``need`` is the size in words of the window that counts,
    ``needed`` the fewest distinct shingles that can cover enough of it.
    """
    listed = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().withColumn("k", F.xxhash64("t"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = Hashes()
        for b in batches:
            rows = []
            for i, t, k in zip(b.i, b.t, b.k):
                # a sentence is named by its words, all of them
                ends, at, nums = [], 0, []
                for w in sentences(t):
                    ends.append((xxhash.xxh3_64_intdigest(" ".join(w)) - (1 << 63), at, at + len(w)))
                    nums += [number[x] for x in w]
                    at += len(w)
                rows.append((i, k, at, shingles(np.array(nums, np.uint64)).tolist(), [e[0] for e in ends], [e[1] for e in ends], [e[2] for e in ends]))
            yield pd.DataFrame(rows, columns=["i", "k", "n", "h", "s", "a", "z"])

    kind = listed.schema["i"].dataType.simpleString()
    cuts, _ = materialize(listed.mapInPandas(cut, f"i {kind}, k long, n int, h array<long>, s array<long>, a array<int>, z array<int>"), "leak-items")
    each = cuts.select("k", F.explode(F.arrays_zip("s", "a", "z")).alias("x")).select("k", "x.*")
    stock = each.select("k", "s").distinct().groupBy("s").count().where(F.col("count") >= least).select("s")
    spans = each.join(stock, "s").distinct().groupBy("k").agg(F.collect_list(F.struct("a", "z")).alias("stock"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, k, n, h, spans in zip(b.i, b.k, b.n, b.h, b.stock):
                flags = np.zeros(n, bool)
                cuts = [(int(x["a"]), int(x["z"])) for x in spans] if spans is not None else []
                for a, z in cuts:
                    flags[a:z] = True
                h = np.array(h, np.int64)
                p = np.flatnonzero(np.convolve(~flags, np.ones(SHINGLE, int), "valid") > 0) if len(h) else np.zeros(0, int)
                need = min(n, max(least_words, math.ceil(share * n)), int((~flags).sum()))
                # a shingle that stands twice may cover twice, so then no more than one is sure
                needed = max(1, math.ceil(dense * need / SHINGLE)) if len(np.unique(h[p])) == len(p) else 1
                if len(p) and need:
                    rows.append((i, k, n, h[p].tolist(), p.tolist(), [a for a, _ in cuts], [z for _, z in cuts], need, needed))
            yield pd.DataFrame(rows, columns=["i", "k", "n", "h", "p", "from", "to", "need", "needed"])

    table = cuts.select("i", "k", "n", "h").join(spans, "k", "left").select("i", "k", "n", "h", "stock")
    return materialize(table.mapInPandas(keep, f"i {kind}, k long, n int, h array<long>, p array<int>, from array<int>, to array<int>, need int, needed int"), "leak-shingles")[0]


def bitmap(held: DataFrame, bits: int) -> np.ndarray:
    """A bit for each shingle of the items: at most ``2**bits / 64`` numbers reach the driver."""
    h = held.select(F.explode("h").alias("h"))
    word, bit = F.shiftrightunsigned("h", 64 - bits + 6), F.shiftrightunsigned("h", 64 - bits).bitwiseAND(F.lit(63))
    got = h.select(word.alias("w"), bit.cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("x"))
    rows = got.toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["x"].to_numpy(np.int64).view(np.uint64)
    return out


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, share: float = 1 / 3, least_words: int = 15, dense: float = 0.8, bits: int = 24) -> DataFrame:
    """(doc_id, item_id, covered_words, item_words, first_word, last_word): documents with the items they hold.

    A document holds an item if a stretch of at least ``share`` of its words, and no fewer than
    ``least_words`` (or the whole item, if shorter), is covered to ``dense`` by common five-word shingles, wherever in the
    document they stand, so any text may stand between its sentences. Sentences that three
    texts of items share are stock instructions and count for nothing. Rows without id or text, and items under five
    words, are in no pair. Rows that repeat an id give one pair with the best cover. ``bits`` sizes the bitmap (2 MB at 24); with
    more items it lets more places through to the exact join, and the result stays the same.
    """
    spark = docs.sparkSession
    held = indexed(items, item_id, item_text, share, least_words, dense)
    shared = spark.sparkContext.broadcast(bitmap(held, bits))
    doc_type = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("doc_id IS NOT NULL AND t IS NOT NULL")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, on = Hashes(), shared.value
        get = number.__getitem__
        for b in batches:
            nums: list[int] = []
            ends = []
            for t in b.t:
                nums += map(get, words(t))
                ends.append(len(nums))
            h = shingles(np.array(nums, np.uint64))
            top = h.view(np.uint64) >> np.uint64(64 - bits)
            p = np.flatnonzero(on[top >> np.uint64(6)] >> (top & np.uint64(63)) & np.uint64(1)) if len(h) else np.zeros(0, int)
            starts = np.array([0, *ends[:-1]])
            lo, hi = np.searchsorted(p, starts), np.searchsorted(p, np.array(ends) - SHINGLE, side="right")
            rows = [(d, xxhash.xxh3_64_intdigest(t) - (1 << 63), e - s, h[p[x:y]].tolist(), (p[x:y] - s).tolist()) for d, t, s, e, x, y in zip(b.doc_id, b.t, starts.tolist(), ends, lo, hi) if y > x]
            yield pd.DataFrame(rows, columns=["doc_id", "t", "n_words", "h", "p"])

    hits, _ = materialize(src.mapInPandas(scan, f"doc_id {doc_type}, t long, n_words int, h array<long>, p array<int>"), "leak-hits")
    own = held.select(F.explode(F.array_distinct("h")).alias("h")).distinct()
    # what the bitmap let through by chance finds no shingle here
    in_docs = hits.select("doc_id", "t", "n_words", F.explode(F.array_distinct("h")).alias("h")).join(broadcast_if_small(own), "h")
    often = in_docs.groupBy("h").agg(F.count("*").alias("df"))
    rare = [F.coalesce("df", F.lit(0)), F.col("h")]
    sized = held.select("i", "k", "needed", F.size(F.array_distinct("h")).alias("size"), F.explode(F.array_distinct("h")).alias("h")).join(often, "h", "left")
    prefix = sized.withColumn("at", F.row_number().over(Window.partitionBy("i", "k").orderBy(*rare))).where("at <= size - needed + 1").select("h", "i", "k", "needed")
    one = Window.partitionBy("doc_id", "t")
    ordered = in_docs.join(often, "h").withColumn("at", F.row_number().over(one.orderBy("df", "h"))).withColumn("m", F.count("*").over(one))
    # the first common shingle in order of rarity must leave enough of the document's shingles after it
    met = ordered.join(broadcast_if_small(prefix), "h").where(F.col("n_words") >= F.col("needed") + SHINGLE - 1).groupBy("doc_id", "t", "i", "k").agg(F.max(F.col("m") - F.col("at") + 1 - F.col("needed")).alias("slack"))
    pairs = met.where("slack >= 0").select("doc_id", "t", "i", "k")
    whole = pairs.join(hits.dropDuplicates(["doc_id", "t"]).withColumnsRenamed({"h": "dh", "p": "dp"}), ["doc_id", "t"]).join(broadcast_if_small(held), ["i", "k"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, i, n, h, p, dh, dp, a, z, need in zip(b.doc_id, b.i, b.n, b.h, b.p, b.dh, b.dp, b["from"], b["to"], b.need):
                covered, stock = np.zeros(n, bool), np.zeros(n, bool)
                here = np.isin(h, dh)
                for j in range(SHINGLE):
                    covered[np.asarray(p)[here] + j] = True
                for x, y in zip(a, z):
                    stock[x:y] = True
                got = stretch(covered, stock, need, dense)
                if got:
                    at = np.asarray(dp)[np.isin(dh, h)]
                    out.append((d, i, got, n, int(at.min()), int(at.max()) + SHINGLE - 1))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "covered_words", "item_words", "first_word", "last_word"])

    id_type = held.schema["i"].dataType.simpleString()
    found = whole.select("doc_id", "i", "n", "h", "p", "dh", "dp", "from", "to", "need").mapInPandas(check, f"doc_id {doc_type}, item_id {id_type}, covered_words int, item_words int, first_word int, last_word int")
    best = F.max(F.struct("covered_words", "item_words", "first_word", "last_word")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
