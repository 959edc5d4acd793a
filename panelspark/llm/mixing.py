"""Mixing overlapping sources to target weights by min-cost flow over membership patterns.

Documents are summed by the set of sources that they belong to, their pattern. Sources share the words of all
documents by weight, and a source stops at three times its own words. Words flow from patterns to sources: a first
copy of a pattern is free, a second and a third cost more and more. Each connected part of patterns and sources is
solved by itself with shortest augmenting paths. The words that a pattern gives are taken as whole copies of all its
documents and one more copy of documents in a seeded order, until the rest is used up; the document at the end of
the rest gives only a part. The order needs no sort of a pattern: hash ranges are summed first, and only the
documents of the range where the rest ends are put in order.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .columns import set_aside
from .store import stored
from .words import blocks, not_white, split

MOST_COPIES = 3
#: Cost of a word of the first, second and third copy.
COPY_COSTS = (0, 1, 3)
WEIGHTS = (1, 2, 3)
SEED = 42
#: Patterns are solved on the driver and sent to all tasks; more of them are refused.
MOST_PATTERNS = 100_000
#: Documents of a pattern in one hash range.
RANGE_DOCS = 5_000
_PLAN = {"_p": pa.string(), "source_sizes": pa.list_(pa.int64()), "targets": pa.list_(pa.float64()), "copies": pa.int64(), "rest": pa.int64(),
         "ranges": pa.int64()}


def with_sizes(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``size``, the number of words; without the text unless ``keep_text``."""
    docs = docs.drop("size")
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(*rest, F.col(text).alias("_text"), F.lit(0).cast("long").alias("size"))

    def count(batches):
        for block in blocks(batches, "_text"):
            sizes = pa.array(split(block.column(len(rest)), not_white()).counts, pa.int64())
            kept = block.columns[:-1] if keep_text else block.columns[:-2]
            yield pa.RecordBatch.from_arrays([*kept, sizes], out)

    rows_out = rows if keep_text else rows.drop("_text")
    out = rows_out.columns
    counted = rows.mapInArrow(count, rows_out.schema)
    return counted.withColumnRenamed("_text", text).select(*docs.columns, "size") if keep_text else counted


def pattern(members) -> F.Column:
    """A set of sources as text; a null source is one of its own."""
    return F.to_json(F.array_sort(F.array_distinct(members)))


def targets(sizes: dict, total: int, weights=WEIGHTS, most_copies: int = MOST_COPIES) -> dict:
    """Share of ``total`` of each source as a fraction (numerator, denominator): by weight, in order of the code points
    of the names with null last, none above ``most_copies`` times its size; what is above goes to the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, rest, out = list(names), total, {}
    while open_:
        share = sum(weight[s] for s in open_)
        full = [s for s in open_ if most_copies * sizes[s] * share < rest * weight[s]]
        if not full:
            out.update((s, (rest * weight[s], share)) for s in open_)
            break
        for s in full:
            out[s] = (most_copies * sizes[s], 1)
            rest -= most_copies * sizes[s]
        open_ = [s for s in open_ if s not in set(full)]
    return {s: out[s] for s in names}


def demands(shares: dict) -> dict:
    """Whole words of each source: fractions rounded down, and the words left to the largest remainders."""
    whole = {s: a // b for s, (a, b) in shares.items()}
    exact = sum(a // b for a, b in shares.values() if not a % b)
    rests = [(a, b) for a, b in shares.values() if a % b]
    left = (sum(a for a, _ in rests) // rests[0][1] if rests else 0) + exact - sum(whole.values())
    order = sorted((s for s, (a, b) in shares.items() if a % b), key=lambda s: (-(shares[s][0] % shares[s][1]), s is None, s or ""))
    for s in order[:left]:
        whole[s] += 1
    return whole


class _Flow:
    """Min-cost flow by shortest augmenting paths with potentials; all costs are zero or more."""

    def __init__(self, n: int):
        self.out, self.to, self.room, self.cost = [[] for _ in range(n)], [], [], []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        price = [0] * len(self.out)
        while True:
            far, back, heap = {source: 0}, {}, [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    nd = d + self.cost[e] + price[x] - price[y]
                    if self.room[e] and nd < far.get(y, 1 << 60):
                        far[y], back[y] = nd, e
                        heapq.heappush(heap, (nd, y))
            if sink not in far:
                return
            for x in range(len(price)):
                price[x] += min(far.get(x, far[sink]), far[sink])
            path, x = [], sink
            while x != source:
                path.append(back[x])
                x = self.to[back[x] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def routed(patterns: list[tuple[tuple, int]], demand: dict, costs=COPY_COSTS) -> list[dict]:
    """Words of each pattern (its sources and size) that go to each of its sources, at the least cost of repetition."""
    parent = {}

    def root(s):
        while parent.setdefault(s, s) != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for members, _ in patterns:
        for s in members[1:]:
            parent[root(s)] = root(members[0])
    parts: dict = {}
    for i, (members, _) in enumerate(patterns):
        if members:
            parts.setdefault(root(members[0]), []).append(i)
    out = [{} for _ in patterns]
    for own in parts.values():
        names = sorted({s for i in own for s in patterns[i][0]}, key=lambda s: (s is None, s or ""))
        at = {s: 2 + len(own) + k for k, s in enumerate(names)}
        flow, links = _Flow(2 + len(own) + len(names)), []
        for k, i in enumerate(own):
            members, size = patterns[i]
            for cost in costs:
                flow.edge(0, 2 + k, size, cost)
            links += [(i, s, flow.edge(2 + k, at[s], len(costs) * size, 0)) for s in members]
        for s in names:
            flow.edge(at[s], 1, demand[s], 0)
        flow.run(0, 1)
        for i, s, e in links:
            out[i][s] = flow.room[e ^ 1]
    return out


def order_key(doc_id, seed: int = SEED):
    """The seeded order of documents: an md5 in hex."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _range(key, ranges):
    """The hash range of a key among ``ranges`` of them."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges / (1 << 32))


def plan(sized: DataFrame, members, doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """One row per pattern: its sources with their sizes and targets, whole copies, and where the rest ends."""
    spark = sized.sparkSession
    rows = sized.select(pattern(members).alias("p"), F.col("size").alias("words"), order_key(F.col(doc_id), seed).alias("k"))
    sums = rows.groupBy("p").agg(F.sum("words"), F.count(F.lit(1))).orderBy("p").limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources; merge rare sources first")
    patterns = [(tuple(json.loads(p)) if p else (), words) for p, words, _ in sums]
    sizes: dict = {}
    for names, words in patterns:
        for s in names:
            sizes[s] = sizes.get(s, 0) + words
    shares = targets(sizes, sum(w for names, w in patterns if names))
    given = routed(patterns, demands(shares))
    out = []
    for (p, words, docs), (names, _), to in zip(sums, patterns, given):
        amount = sum(to.values())
        out.append((p, [sizes[s] for s in names], [shares[s][0] / shares[s][1] for s in names],
                    amount // words if words else 0, amount % words if words else 0, max(1, docs // RANGE_DOCS)))
    # from Arrow: rows as Python objects would be read by workers of another kind, which stay beside those at work
    made = spark.createDataFrame(pa.table([pa.array([row[i] for row in out], kind) for i, kind in enumerate(_PLAN.values())], [*_PLAN]))
    # where the rest ends: the first hash range whose running sum reaches it
    ranged = rows.join(F.broadcast(made.select("_p", "ranges", "rest")), F.col("p") == F.col("_p"))
    range_sums = ranged.groupBy("p", _range(F.col("k"), F.col("ranges")).alias("r")).agg(F.sum("words").alias("n"), F.max("rest").alias("rest"))
    upto = range_sums.withColumn("upto", F.sum("n").over(W.partitionBy("p").orderBy("r").rowsBetween(W.unboundedPreceding, 0)))
    ends = upto.where("upto >= rest").groupBy("p").agg(F.min(F.struct("r", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
    return stored(made.join(ends, F.col("_p") == F.col("p"), "left").select(
        made["*"], F.coalesce("e.r", F.lit(-1)).alias("last_range"), F.coalesce("e.before", F.lit(0)).alias("before")))


def taken(rows: DataFrame, planned: DataFrame, members, doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``rows`` (with ``size``) and ``source_sizes``, ``targets`` and ``taken``, the words that the mix takes of each."""
    rows = rows.drop("source_sizes", "targets", "taken")
    names = [*rows.columns, "source_sizes", "targets"]
    joined = rows.withColumns({"_pattern": pattern(members), "_key": order_key(F.col(doc_id), seed)}).join(
        F.broadcast(planned), F.col("_pattern") == F.col("_p")).withColumn("_r", _range(F.col("_key"), F.col("ranges")))
    all_copies = F.col("copies") * F.col("size")
    away = joined.where("_r <> last_range").select(*names, (all_copies + F.when(
        F.col("_r") < F.col("last_range"), F.col("size")).otherwise(0)).alias("taken"))
    order = W.partitionBy("_pattern").orderBy("_key", doc_id, "size").rowsBetween(W.unboundedPreceding, 0)
    at_end = joined.where("_r = last_range").withColumn("_start", F.col("before") + F.sum("size").over(order) - F.col("size"))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_start")))
    return away.union(at_end.select(*names, (all_copies + more).alias("taken")))


def mixed(docs: DataFrame, members=None, text: str = "text", doc_id: str = "doc_id", keep_text: bool = True, seed: int = SEED
          ) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_sizes``, ``targets`` and ``taken``.

    ``members`` is an array column of the sources of a row, by default its one ``source``; null is a source, an
    empty set takes no part and is left out. A null text has size 0 and gives nothing. Equal rows may take different
    shares, as the rest may end between them; which of them gives more does not matter. Reruns agree.
    """
    aside = set_aside(docs, {"doc_id": doc_id, "text": text}, members=F.array("source") if members is None else members)
    members, extra = F.col("members"), ("size", "source_sizes", "targets", "taken")
    sized = stored(with_sizes(aside.rows if not keep_text else aside.rows.select("doc_id", "members", "text")))
    planned = plan(sized, members, seed=seed)
    result = taken(with_sizes(aside.rows, keep_text=True) if keep_text else sized, planned, members, seed=seed)
    return aside.back(result, extra, without=() if keep_text else (text,))
