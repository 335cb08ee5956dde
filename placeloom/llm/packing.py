"""Filling fixed-capacity containers with documents measured in tokens.

Lengths are whole numbers up to the capacity, so everything a packing needs to know about a
corpus of any size is one count per length. The packing itself runs on that histogram (never
more than ``capacity`` rows), hierarchically: lengths are routed to tiers of windows (capacity, 1/2, 1/4, ...), each tier is
packed into windows of its own size after its documents have filled the gaps of longer windows, and windows of shorter
tiers are put together two by two until they make containers. A text thus never crosses the border of its
window, and a container may also be read as windows of a shorter context.
What comes out is a table of slots, each saying "documents of this length with ranks s..t go to
containers b, b+1, ..."; every document then finds its slot by its rank among those of its
length. Ranks come from counts per (length, hash bucket), with more buckets for a length the more documents have it, so
a length that a third of all documents share is ranked by many tasks.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_encoder(path: str):
    """The tokenizer in ``path`` (ranks in tiktoken form), special tokens treated as text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = load_encoder(path)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


Runs = tuple[tuple[int, int, int], ...]


def pack_histogram(counts: dict[int, int], capacity: int, tiers: int = 4) -> list[tuple[int, Runs]]:
    """(number of containers, runs of (length, copies, offset) in each) that hold exactly ``counts`` items.

    Containers that look alike are one pattern, so the work depends on the number of distinct
    lengths and not on the number of items; each length adds at most three patterns.
    """
    gaps: dict[int, list[tuple[int, int, Runs]]] = {}  # free room -> (windows, size, runs)
    rooms: list[int] = []

    def put(room: int, n: int, size: int, runs: Runs) -> None:
        if not gaps.get(room):
            gaps[room] = []
            insort(rooms, room)
        gaps[room].append((n, size, runs))

    def fill(length: int, n: int) -> int:
        """Best fit: the tightest gaps first, as many copies as fit."""
        while n and rooms and rooms[-1] >= length:
            room = rooms[bisect_left(rooms, length)]
            have, size, runs = gaps[room].pop()
            if not gaps[room]:
                rooms.remove(room)
            copies = min(room // length, n)
            used = min(have, n // copies)
            if have > used:
                put(room, have - used, size, runs)
            put(room - copies * length, used, size, (*runs, (length, copies, size - room)))
            n -= used * copies
        return n

    sizes = [capacity >> t for t in range(max(1, tiers)) if capacity >> t]
    for size, low in zip(sizes, [*sizes[1:], 0]):
        for length in sorted((x for x in counts if low < x <= size), reverse=True):
            left = fill(length, counts[length])
            each = size // length
            if left // each:
                put(size - each * length, left // each, size, ((length, each, 0),))
            if left % each:
                put(size - left % each * length, 1, size, ((length, left % each, 0),))
    windows: dict[int, list[tuple[int, Runs]]] = {x: [] for x in sizes}
    for room in rooms:
        for n, size, runs in gaps[room]:
            windows[size].append((n, runs))
    for size, twice in zip(sizes[:0:-1], sizes[-2::-1]):
        one: Runs | None = None
        shifted = lambda runs: tuple((k, c, at + size) for k, c, at in runs)  # noqa: E731, B023
        for n, runs in sorted(windows[size], key=lambda w: (w[1], w[0])):
            if one is not None:
                windows[twice].append((1, one + shifted(runs)))
                n, one = n - 1, None
            if n // 2:
                windows[twice].append((n // 2, runs + shifted(runs)))
            if n % 2:
                one = runs
        if one is not None:
            windows[twice].append((1, one))
    return windows[capacity]


def slots_of(patterns: list[tuple[int, Runs]]) -> pd.DataFrame:
    """One row per slot: length, first rank, containers, copies in each, first container, place in the container.

    Costly containers (sum of squared lengths, the price of attention) come first, so numbering
    them off in a snake over step groups gives groups of like cost.
    """
    patterns = sorted(patterns, key=lambda p: (-sum(c * x * x for x, c, _ in p[1]), p[1]))
    rank: dict[int, int] = {}
    out, first = [], 0
    for n, runs in patterns:
        for k, copies, at in runs:
            out.append((k, rank.get(k, 0), n, copies, first, at))
            rank[k] = rank.get(k, 0) + n * copies
        first += n
    return pd.DataFrame(out, columns=["length", "first_rank", "n", "copies", "first_container", "at"]).astype("int64")


def sizes(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """A stored table (doc_id, _len): the tokens of each row's whole text."""
    return materialize(docs.select(F.col(doc_id).alias("doc_id"), token_count(F.col(text), tokenizer).alias("_len")), "sizes")[0]


def pack(docs: DataFrame, doc_id: str, text: str, capacity: int = 2048, tiers: int = 4, step_size: int = 64, tokenizer: str = TOKENIZER, bucket_rows: int = 250_000) -> DataFrame:
    """(doc_id, part, n_tokens, container_id, token_offset, step_group): one row per piece.

    A text within the capacity is one piece (part 0). A longer one is cut into pieces of exactly
    ``capacity`` tokens and a rest, parts 0, 1, ...; nothing else is ever split. Null and empty
    texts have one row with 0 tokens and no container. Rows are told apart by ``doc_id``; rows that
    repeat an id are packed each for itself. ``step_group`` numbers groups of about ``step_size``
    containers of like total cost. An empty table gives no rows.
    """
    return packed(sizes(docs, doc_id, text, tokenizer), capacity, tiers, step_size, bucket_rows)


def packed(sized: DataFrame, capacity: int = 2048, tiers: int = 4, step_size: int = 64, bucket_rows: int = 250_000) -> DataFrame:
    """:func:`pack` from the table of :func:`sizes`."""
    whole = F.floor(F.col("_len") / capacity)
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_len") / capacity).cast("int") - 1))
    items = sized.select("doc_id", F.explode(pieces).alias("part"), "_len").select(
        "doc_id", "part", F.when(F.col("part") < whole, F.lit(capacity)).otherwise(F.col("_len") - F.col("part") * capacity).cast("long").alias("n_tokens"))
    full = items.where("n_tokens > 0")
    # at most ``capacity`` rows; then one more for every ``bucket_rows`` pieces
    counts = full.groupBy("n_tokens").count().toPandas().sort_values("n_tokens")
    spread = pd.DataFrame({"n_tokens": counts["n_tokens"].astype("int64"), "_many": (counts["count"] // bucket_rows + 1).astype("int64")})
    many = sized.sparkSession.createDataFrame(spread, "n_tokens long, _many long")
    full = full.join(F.broadcast(many), "n_tokens").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "part"), F.col("_many"))).drop("_many")
    each = full.groupBy("n_tokens", "_bucket").count().toPandas().sort_values(["n_tokens", "_bucket"])
    before = each.groupby("n_tokens")["count"].cumsum() - each["count"]
    base = {(int(a), int(b)): int(c) for a, b, c in zip(each["n_tokens"], each["_bucket"], before)}
    slots = slots_of(pack_histogram({int(k): int(v) for k, v in zip(counts["n_tokens"], counts["count"])}, capacity, tiers)).sort_values(["length", "first_rank"])
    made = int((slots.first_container + slots.n).max()) if len(slots) else 0
    groups = max(1, -(-made // step_size))
    wide = np.int64(1) << 42
    keys = slots.length.to_numpy() * wide + slots.first_rank.to_numpy()
    length0, container0, offset0, rank0, copies0 = (slots[c].to_numpy() for c in ("length", "first_container", "at", "first_rank", "copies"))

    @F.pandas_udf("container_id long, token_offset long, step_group long")
    def place(length: pd.Series, bucket: pd.Series, within: pd.Series) -> pd.DataFrame:
        rank = np.fromiter((base[x] for x in zip(length, bucket)), np.int64, len(length)) + within.to_numpy(np.int64)
        k = np.searchsorted(keys, length.to_numpy(np.int64) * wide + rank, side="right") - 1
        turn, copy = np.divmod(rank - rank0[k], copies0[k])
        container = container0[k] + turn
        lap, step = np.divmod(container, groups)
        return pd.DataFrame({"container_id": container, "token_offset": offset0[k] + copy * length0[k], "step_group": np.where(lap % 2, groups - 1 - step, step)})

    ranked = full.withColumn("_within", F.row_number().over(Window.partitionBy("n_tokens", "_bucket").orderBy("doc_id", "part")) - 1)
    placed = ranked.withColumn("_p", place("n_tokens", "_bucket", "_within")).select("doc_id", "part", "n_tokens", "_p.container_id", "_p.token_offset", "_p.step_group")
    blank = items.where("n_tokens <= 0").select("doc_id", "part", F.lit(0).cast("long").alias("n_tokens"), *[F.lit(None).cast("long").alias(c) for c in ("container_id", "token_offset", "step_group")])
    return placed.unionByName(blank)


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, share of room used, fullest and emptiest step group's cost."""
    per = packed.where("container_id IS NOT NULL").groupBy("container_id", "step_group").agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("c"))
    groups = per.groupBy("step_group").agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.sum("c").alias("c"))
    return groups.agg(F.sum("n").alias("containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.sum("n") * capacity)).alias("used"), F.min("c").alias("least_cost"), F.max("c").alias("most_cost"))
