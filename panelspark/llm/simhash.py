"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints that differ in at most four bits are linked. A fingerprint has three segments (22, 21 and 21 bits).
Either one segment is equal in both, and of the other two one differs in at most two bits; or all three differ, two
of them in one bit and the third in at most two. So a pair shares one of these keys:

* an equal segment with a Golay codeword near another segment (6 choices of the two), or
* an equal half of two segments with a Golay codeword near the third (12 choices).

A segment has one to six near codewords (see ``golay``). All distinct fingerprints with a key are compared exactly.
Only links that join two so far separate sets leave a task, so a large group of copies gives a tree, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import quoted, set_aside
from .components import components
from .golay import near_codewords
from .store import stored
from .words import blocks, not_white, split

SHINGLE = 4
DISTANCE = 4
#: First bit and length of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Runs of up to this many fingerprints with one key are compared all at once, longer ones one by one against the rest.
SHORT_RUN = 12
#: Fingerprints whose keys are made at a time: about fifty keys of 16 bytes for each.
KEYED = 2_000


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints of texts: a bit is set if it is set in more than half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = split(column, not_white(), lower=True)
    counts = words.counts
    values, sizes = [], np.zeros(len(counts), np.int64)
    for row in np.flatnonzero(counts):
        text = b" ".join(words.row_bytes(row).split())
        lo, hi = words.first[row], words.first[row + 1]
        ends = np.cumsum(words.ends[lo:hi] - words.starts[lo:hi] + 1) - 1
        ends = ends[min(shingle, hi - lo) - 1:]
        starts = np.r_[0, np.cumsum(words.ends[lo:hi] - words.starts[lo:hi] + 1)][:len(ends)]
        values += [xxh64_intdigest(text[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())]
        sizes[row] = len(ends)
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.r_[0, np.cumsum(sizes[some])[:-1]]
        sums = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * sums > sizes[some, None], axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` but the text, and ``fp``, the fingerprint as a signed number."""
    rest = [c for c in docs.columns if c not in (text, "fp")]
    rows = docs.select(*rest, F.col(text).alias("_text"))
    schema = docs.select(*rest).withColumn("fp", F.lit(0).cast("long")).schema

    def take(batches):
        for block in blocks(batches, "_text"):
            fp = fingerprints(block.column(block.num_columns - 1), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(fp)], [*rest, "fp"])

    return rows.mapInArrow(take, schema)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints and the index of the fingerprint of each."""
    segments = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [near_codewords(s) for s in segments]
    halves = [(s >> 11, s & 2047) for s in segments]
    out, who, kind = [], [], 0

    def add(exact: np.ndarray, j: int):
        nonlocal kind
        code = near[j]
        key = (np.int64(kind) << 40) | (exact[:, None] << 12) | code
        use = code >= 0
        out.append(key[use])
        who.append(np.nonzero(use)[0])
        kind += 1

    for i in range(3):
        for j in range(3):
            if i != j:
                add(segments[i], j)
    for k in range(3):
        i, j = (x for x in range(3) if x != k)
        for a in halves[i]:
            for b in halves[j]:
                add((a << 11) | b, k)
    return np.concatenate(out), np.concatenate(who)


def linked(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join distinct fingerprints to their sets under the relation of at most ``distance`` differing bits."""
    rest, a, b = np.arange(len(fps)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            close = np.bitwise_count(fps[rest] ^ fps[x]) <= distance
            found = rest[close]
            if len(found):
                a.append(np.full(len(found), x))
                b.append(found)
                queue += found.tolist()
                rest = rest[~close]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


class _Forest:
    """Sets of numbers that are joined one link after the other."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent, path = self.parent, []
        while (up := parent.get(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            parent[y] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _run_links(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints with equal keys; keys are sorted."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    a, b = [], []
    for gap in range(1, min(int(size.max()), SHORT_RUN)):
        same = np.flatnonzero((key[gap:] == key[:-gap]) & np.repeat(size <= SHORT_RUN, size)[gap:])
        same = same[np.bitwise_count(fp[same] ^ fp[same + gap]) <= distance]
        a.append(fp[same])
        b.append(fp[same + gap])
    for s, n in zip(start[size > SHORT_RUN], size[size > SHORT_RUN]):
        own = np.unique(fp[s:s + n])
        i, j = linked(own, distance)
        a.append(own[i])
        b.append(own[j])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a`` and ``b``: links between distinct fingerprints (column ``fp``) that connect all that are connected."""
    if distance > DISTANCE:
        raise ValueError(f"keys find pairs of at most {DISTANCE} differing bits")

    def emit(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, KEYED):
                fp = batch.column(0).slice(lo, KEYED).to_numpy().view(np.uint64)
                key, who = keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[who].view(np.int64))], ["key", "fp"])

    def compare(batches):
        forest, key, fp = _Forest(), np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def new_links(upto: int):
            a, b = _run_links(key[:upto], fp[:upto], distance)
            both = np.unique(np.stack([a.view(np.int64), b.view(np.int64)]), axis=1)
            return [p for p in zip(*both.tolist()) if forest.join(*p)]

        for batch in batches:
            key = np.r_[key, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy().view(np.uint64)]
            upto = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            if upto:
                yield _pairs(new_links(upto))
                key, fp = key[upto:], fp[upto:]
        if len(key):
            yield _pairs(new_links(len(key)))

    dealt = distinct.select("fp").mapInArrow(emit, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, distance: int = DISTANCE
            ) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id of the rows that are connected, for every row.

    Words of a null or blank text: none, so its fingerprint is zero and linked like any other; fewer words than a
    shingle are one shingle. Equal rows share their component. A row without id gives no id to its component; a
    component of such rows only has none. An empty table gives no row.
    """
    rows = stored(with_fingerprints(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")), "text", shingle))
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = stored(links(least, distance))
    roots = components(edges)
    # stored, so that Spark splits the join at a root of very many fingerprints
    named = stored(least.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    of_root = stored(named.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = named.join(of_root, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of each component, that with the smallest id, all columns; rows without id all stay."""
    aside = set_aside(docs, {"doc_id": doc_id, "text": text})
    chosen = grouped(aside.rows, **options).where("component_id is not null").select(F.col("component_id").alias("chosen")).distinct()
    with_id = aside.rows.where("doc_id is not null").join(chosen, F.col("doc_id") == F.col("chosen"), "left_semi")
    return aside.back(with_id.dropDuplicates(["doc_id"]).union(aside.rows.where("doc_id is null")))
