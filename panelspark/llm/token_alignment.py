"""Alignment of two tokenizers on the bytes of texts: groups of tokens, links of overlapping tokens, and how firm links are.

Spans of the libraries are coarse cuts: character offsets of the first tokenizer, spans of the second's proto. Where a
character's bytes lie in several tokens, or a token stands for one byte, those spans don't say where a token ends; such ends come
from the lengths of the decoded bytes since the last coarse cut. Decoded bytes must be those of the text, or it has no tokens.

Texts are cut at spaces that no token of either file crosses; each distinct piece is encoded and aligned once while it is
remembered. Tasks store, per chunk of texts, the links of the distinct pieces and the pieces of each text; the pairs of ids of
a chunk with their counts are rows that Spark adds up over the corpus, and the totals return to the chunks by a join.
"""

from __future__ import annotations

import gc
import hashlib
import os
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .columns import quoted
from .store import discard, stored
from .tokens import SAFE, _starts_words_at_spaces
from .words import blocks

#: Text bytes of a chunk, and distinct pieces and their characters that a task remembers; a full memory ends the chunk.
CHUNK_BYTES, REMEMBERED, REMEMBERED_CHARS = 16 << 20, 400_000, 48 << 20
#: Characters that go to the libraries in one call.
BATCH_CHARS = 1 << 18
#: Pieces between spaces that a library gets as one text.
LINE = 20

_PER_TEXT = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """Byte of each character of byte-level entries: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """The first tokenizer: ids, ends of tokens and decoded bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.decoded = {i: bytes(map(alphabet.__getitem__, t)) for t, i in self.library.get_vocab(with_added_tokens=False).items()
                        if set(t) <= alphabet.keys()}
        self.sizes = _sizes(self.decoded)
        self.cuts = _starts_words_at_spaces(path)

    def __call__(self, pieces: list[str]):
        """Ids, number of them per piece, coarse end of each token in bytes of the pieces with a space before each, and trust."""
        found = self.library.encode_batch([" " + p for p in pieces], add_special_tokens=False)
        ids = [e.ids for e in found]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64, 2 * counts.sum()).reshape(-1, 2)
        data = np.frombuffer("".join(" " + p for p in pieces).encode(), np.uint8)
        heads = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # first byte of each character
        chars = np.r_[0, np.cumsum([len(p) + 1 for p in pieces])]
        base = np.repeat(chars[:-1], counts)
        begin, end = spans[:, 0] + base, spans[:, 1] + base
        trusted = np.r_[begin[1:] >= end[:-1], True][:len(end)]  # the next token shares no character
        return np.fromiter(chain.from_iterable(ids), np.int64, counts.sum()), counts, heads[end], trusted


def _sizes(decoded: dict[int, bytes]) -> np.ndarray:
    sizes = np.zeros(max(decoded) + 1, np.int64)
    sizes[list(decoded)] = list(map(len, decoded.values()))
    return sizes


class Pieces:
    """The second tokenizer: the same; it puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.is_byte = np.array([self.library.is_byte(i) for i in range(n)])
        self.decoded = {i: bytes([int(p[3:5], 16)]) if self.is_byte[i] else p.replace("▁", " ").encode() for i, p in enumerate(names)}
        self.sizes = _sizes(self.decoded)
        probe = "a  b ﬁ\n"
        kept = b"".join(self.decoded[i] for i in self.library.encode(probe)) == (" " + probe).encode()
        self.cuts = kept and not any("▁" in p.lstrip("▁") for p in names)

    def __call__(self, pieces: list[str]):
        found = [p.pieces for p in self.library.encode(pieces, return_type="proto", num_threads=1)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        tokens = [t for p in found for t in p]
        ids, end = np.array([t.id for t in tokens], np.int64), np.array([t.end for t in tokens], np.int64)
        before = np.r_[0, np.cumsum([len(p.encode()) + 1 for p in pieces])]
        return ids, counts, end + 1 + np.repeat(before[:-1], counts), ~self.is_byte[ids]


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def refined(coarse: np.ndarray, trusted: np.ndarray, length: np.ndarray, start: np.ndarray) -> np.ndarray:
    """End of each token: the coarse end where it is trusted, else the decoded bytes since the last trusted end or ``start`` (the
    start of the token's piece)."""
    total = np.cumsum(length)
    place = np.arange(len(coarse))
    last = np.maximum.accumulate(np.where(trusted, place, -1)) if len(place) else place
    fresh = np.r_[True, start[1:] != start[:-1]][:len(start)]
    opened = np.maximum.accumulate(np.where(fresh, place, 0)) if len(place) else place
    from_piece = last < opened
    base = np.where(from_piece, start, coarse[np.maximum(last, 0)])
    since = total - np.where(from_piece, total[opened] - length[opened], total[np.maximum(last, 0)])
    return np.where(trusted, coarse, base + since)


@contextmanager
def _no_garbage():
    """Millions of short-lived tuples without cycles: counting references frees them, searching for cycles takes a quarter of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Aligner:
    """Aligned pieces, remembered by their text."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _tokenizer(path_a), _tokenizer(path_b)
        self.cuts = self.a.cuts and self.b.cuts
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.parts: list[tuple] = []
        self.chars = 0

    def full(self) -> bool:
        return len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS

    def pieces(self, text: str) -> list[str]:
        return SAFE.split(text) if self.cuts else [text]

    def learn(self, pieces: set[str]) -> None:
        batch, size = [], 0
        with _no_garbage():
            for piece in pieces:
                batch.append(piece)
                size += len(piece) + 1
                if size >= BATCH_CHARS:
                    self._align(batch)
                    batch, size = [], 0
            if batch:
                self._align(batch)

    def _align(self, pieces: list[str]) -> None:
        if self.cuts:  # pieces between spaces stand after one another in lines, as they would in a text
            plain = [p for p in pieces if not (p[:1].isspace() or p[-1:].isspace())]
            odd = [p for p in pieces if p[:1].isspace() or p[-1:].isspace()]
            pieces, lines = plain + odd, [" ".join(plain[i:i + LINE]) for i in range(0, len(plain), LINE)] + odd
        else:
            lines = pieces
        first = len(self.known)
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        self.chars += sum(map(len, pieces))
        wanted = [b" " + p.encode() for p in pieces]
        bounds = np.r_[0, np.cumsum(np.fromiter(map(len, wanted), np.int64, len(wanted)))]
        of_line = np.r_[0, np.cumsum(np.fromiter((len(x.encode()) + 1 for x in lines), np.int64, len(lines)))]
        sides = []
        for side in (self.a, self.b):
            ids, counts, coarse, trusted = side(lines)
            end = refined(coarse, trusted, side.sizes[ids], of_line[np.repeat(np.arange(len(lines)), counts)])
            sides.append((side, ids, end, np.searchsorted(bounds, end, "left") - 1))
        good = np.logical_and(*(_keeps(ids, own, side, wanted) for side, ids, _, own in sides))
        flat, ends, owner = zip(*((ids[good[own]], end[good[own]], own[good[own]]) for _, ids, end, own in sides))
        (a, b), (ea, eb), (oa, ob) = flat, ends, owner
        sa = np.r_[0, ea[:-1]][:len(ea)]
        sa = np.where(np.r_[True, oa[1:] != oa[:-1]][:len(oa)], bounds[oa], sa)  # skipped pieces leave gaps
        low = np.searchsorted(eb, sa, "right")
        n_over = np.searchsorted(eb, ea, "left") - low + 1
        link_b = np.arange(n_over.sum()) - np.repeat(np.cumsum(n_over) - n_over, n_over) + np.repeat(low, n_over)
        codes = (np.repeat(a, n_over) << 32) | b[link_b]
        per = lambda o, w=None: np.bincount(o, w, len(pieces)).astype(np.int64)
        cut_a, cut_b = np.isin(ea, eb, assume_unique=True), np.isin(eb, ea, assume_unique=True)
        n_links = per(oa, n_over)
        self.parts.append((good, per(oa), per(ob), per(oa[cut_a]), n_links, codes))
        self.groups += _written(len(pieces), a, b, oa, cut_a, cut_b)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per piece: goodness and the counts; the links of all pieces (``a << 32 | b``), one piece after the other, and their bounds."""
        good = np.concatenate([p[0] for p in self.parts])
        counts = np.stack([np.concatenate([p[i] for p in self.parts]) for i in range(1, 5)])
        return good, counts, np.concatenate([p[5] for p in self.parts]), np.r_[0, np.cumsum(counts[3])]


def _keeps(ids: np.ndarray, own: np.ndarray, side, wanted: list[bytes]) -> np.ndarray:
    """Whether the decoded tokens of each piece are its bytes."""
    found = b"".join(map(side.decoded.__getitem__, ids.tolist()))
    size = np.bincount(own, side.sizes[ids], len(wanted)).astype(np.int64)
    if found == b"".join(wanted) and size.tolist() == list(map(len, wanted)):
        return np.ones(len(wanted), bool)
    ends = np.r_[0, np.cumsum(size)].tolist()
    return np.fromiter((found[lo:hi] == w for lo, hi, w in zip(ends, ends[1:], wanted)), bool, len(wanted))


def _written(n_pieces: int, a: np.ndarray, b: np.ndarray, oa: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2`` for each piece."""
    end_a, end_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    first_a, first_b = np.r_[0, end_a[:-1]][:len(end_a)], np.r_[0, end_b[:-1]][:len(end_b)]
    out = [f"{x}|{y}" for x, y in zip(a[first_a].tolist(), b[first_b].tolist())]  # most groups have one token on either side
    more = np.flatnonzero((end_a - first_a > 1) | (end_b - first_b > 1))
    bounds = [x[more].tolist() for x in (first_a, end_a, first_b, end_b)]
    ids_a, ids_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    for k, i, x, j, y in zip(more.tolist(), *bounds):
        out[k] = ",".join(ids_a[i:x]) + "|" + ",".join(ids_b[j:y])
    of = np.searchsorted(oa[cut_a], np.arange(n_pieces + 1)).tolist()
    return [";".join(out[lo:hi]) for lo, hi in zip(of, of[1:])]


def _read(batches, path_a: str, path_b: str, most_bytes: int):
    """Blocks of rows with the pieces of their texts, learned; ``None`` where the memory is emptied."""
    aligner = Aligner(path_a, path_b)
    size = 0
    for block in blocks(batches):
        texts = [x or "" for x in block.column(block.num_columns - 1).to_pylist()]
        pieces = [aligner.pieces(t) if t else [] for t in texts]
        new = {p for row in pieces for p in row}
        n_bytes = sum(map(len, texts))
        if size and (aligner.full() or size + n_bytes > most_bytes):
            yield aligner, None, None
            size = 0
            if aligner.full():
                aligner.forget()
        size += n_bytes
        aligner.learn(new - aligner.known.keys())
        yield aligner, block, [list(map(aligner.known.__getitem__, row)) for row in pieces]
    if size:
        yield aligner, None, None


def token_groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``groups`` of every row: its smallest groups of tokens with equal bytes, as ``a1,a2|b1;a3|b2,b3``.

    The first file's tokens are those of a space and the text, the second's those of the text, before which that
    library puts a space. Null and empty texts, and those that either library doesn't keep byte by byte, have the empty string.
    """
    keep = tuple(c for c in keep if c != "groups")
    rows = docs.select(*(quoted(c).alias(f"kept_{i}") for i, c in enumerate(keep)), quoted(text).alias("text"))
    schema = rows.withColumnRenamed("text", "groups").schema

    def each(batches):
        for aligner, block, pieces in _read(batches, path_a, path_b, CHUNK_BYTES):
            if block is not None:
                good = np.concatenate([p[0] for p in aligner.parts]) if aligner.parts else np.zeros(0, bool)
                written = [";".join(map(aligner.groups.__getitem__, row)) if good[row].all() else "" for row in pieces]
                yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(written, pa.string())], schema.fieldNames())

    out = rows.mapInArrow(each, schema)
    return out.select(*(quoted(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "groups")


def _chunks(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Chunks of texts: ``rows`` (kept columns, counts, digest and the pieces of each), and the links of the pieces that occur."""

    def flushed(number, held, aligner):
        good, counts, codes, bounds = aligner.table() if aligner.parts else (np.zeros(0, bool), np.zeros((4, 0), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
        tables, used = [], []
        for block, pieces in held:
            n = np.array([len(x) for x in pieces], np.int64)
            flat = np.fromiter((i for x in pieces for i in x), np.int64, n.sum())
            row = np.repeat(np.arange(len(n)), n)
            whole = np.bincount(row, ~good[flat], len(n)) == 0
            flat, row = flat[whole[row]], row[whole[row]]
            sums = [pa.array(np.bincount(row, c[flat], len(n)).astype(np.int64)) for c in counts]
            digest = [hashlib.sha256(";".join(map(aligner.groups.__getitem__, x)).encode()).hexdigest() if x and w else "" for x, w in zip(pieces, whole)]
            used.append((flat, np.bincount(row, minlength=len(n))))
            tables.append(pa.RecordBatch.from_arrays([*block.columns[:-1], *sums, pa.array(digest, pa.string())],
                                                     [*block.schema.names[:-1], *_PER_TEXT, "groups_sha256"]))
        which = np.concatenate([f for f, _ in used])
        times = np.bincount(which, minlength=len(good))
        alive = np.flatnonzero(times)
        alive = alive[np.argsort(-times[alive], kind="stable")]  # frequent pieces get small numbers, which pack well
        rename = np.zeros(len(good), np.uint32)
        rename[alive] = np.arange(len(alive))
        lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(rename[f])) for f, n in used]
        packed = [pa.RecordBatch.from_arrays([*t.columns, x], [*t.schema.names, "pieces"]) for t, x in zip(tables, lists)]
        size = np.diff(bounds)[alive]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        links = codes[np.repeat(bounds[alive], size) + inner]
        pair, place = np.unique(links, return_inverse=True)
        of = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(place.astype(np.uint32)))
        n = np.bincount(place, np.repeat(times[alive], size), len(pair)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), _ipc(packed), _ipc([pa.RecordBatch.from_arrays([of], ["links"])]),
             _ipc([pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])])], ["chunk", "rows", "links", "pairs"])

    def each(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []
        for aligner, block, pieces in _read(batches, path_a, path_b, CHUNK_BYTES):
            if block is not None:
                held.append((block, pieces))
            elif held:
                yield flushed(number, held, aligner)
                number, held = number + 1, []

    return stored(rows.mapInArrow(each, "chunk long, rows binary, links binary, pairs binary"))


def _ipc(batches: list[pa.RecordBatch]) -> pa.Array:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    return pa.array([sink.getvalue().to_pybytes()], pa.binary())


def _opened(value: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks()


def _chunk_pairs(batches):
    for batch in batches:
        for chunk, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            pairs = _opened(value)
            code = pairs.column("pair").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), chunk)), pa.array((code >> 32).astype(np.int32)), pa.array(code.astype(np.int32)),
                                              pairs.column("n").combine_chunks()], ["chunk", "a", "b", "n"])


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``a``, ``b``, ``total`` (links of the pair in the corpus) and ``best`` (no pair of that ``b`` has more)."""
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    return totals.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy("b")))


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row with ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links`` (pairs of tokens with bytes in common),
    ``n_best`` (links of a pair of ids that no other pair with that second id exceeds in the corpus, ties included), ``count_sum`` (sum
    of the corpus counts of the links' pairs) and ``groups_sha256`` (of ``token_groups``; empty without tokens).

    Null and empty texts, and texts whose tokens don't decode to their bytes, have zeros. Equal rows each count. An
    empty table gives no row. Results replace kept columns of their names. Both paths must be readable where tasks run.
    """
    keep = tuple(c for c in keep if c not in (*_PER_TEXT, "n_best", "count_sum", "groups_sha256"))
    rows = docs.select(*(quoted(c).alias(f"kept_{i}") for i, c in enumerate(keep)), quoted(text).alias("text"))
    names = [f"kept_{i}" for i in range(len(keep))]
    out = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"{c} bigint" for c in _PER_TEXT),
                     "n_best bigint", "count_sum bigint", "groups_sha256 string"])
    chunks = _chunks(rows, path_a, path_b)
    pairs = stored(chunks.select("chunk", "pairs").mapInArrow(_chunk_pairs, "chunk long, a int, b int, n long"))
    answers = pairs.select("chunk", "a", "b").join(pair_counts(pairs), ["a", "b"])

    def use(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, links = _opened(left.column("rows")[0]), _opened(left.column("links")[0]).column("links")
        a, b, total, best = (right.column(c).to_numpy() for c in ("a", "b", "total", "best"))
        order = np.argsort((a.astype(np.int64) << 32) | b)  # the chunk's pairs are numbered in this order
        links = links.chunk(0) if links.num_chunks else pa.array([], pa.list_(pa.uint32()))
        place = links.values.to_numpy()
        of = np.repeat(np.arange(len(links)), np.diff(links.offsets.to_numpy()))
        per_piece = [np.zeros(len(links), np.int64) for _ in range(2)]
        for sums, value in zip(per_piece, (best[order].astype(np.int64), total[order].astype(np.int64))):
            np.add.at(sums, of, value[place])
        found = [[], []]
        for pieces in rows.column("pieces").chunks:
            n = np.diff(pieces.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            for have, sums in zip(found, per_piece):
                total_of = np.zeros(len(n), np.int64)
                np.add.at(total_of, row, sums[pieces.values.to_numpy()])
                have.append(total_of)
        n_best, count_sum = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in found)
        return pa.Table.from_arrays([*(rows.column(c) for c in (*names, *_PER_TEXT)), n_best, count_sum, rows.column("groups_sha256")],
                                    [*names, *_PER_TEXT, "n_best", "count_sum", "groups_sha256"])

    result = stored(chunks.select("chunk", "rows", "links").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(use, out))
    discard(chunks)
    discard(pairs)
    return result.select(*(quoted(f"kept_{i}").alias(c) for i, c in enumerate(keep)), *_PER_TEXT, "n_best", "count_sum", "groups_sha256")
