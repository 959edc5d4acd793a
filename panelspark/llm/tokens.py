"""Token counts of whole texts by a public tokenizer file.

Texts are cut at safe boundaries, the single spaces that stand between two characters that are no white space: a
byte-level tokenizer with the usual word pattern starts a new word at such a space, so the pieces are tokenized as
they would be in place. Pieces of a task repeat, so each is encoded once and its length remembered; the pieces not
seen before go to the library in batches balanced by bytes. Only lengths leave the task.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .words import blocks

#: A space with a character of another kind on either side. Python's white space includes the library's.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Bytes that the library gets in one call.
BATCH_BYTES = 1 << 20
#: Remembered pieces of a task; the memory is emptied when it is full, which changes no result.
REMEMBERED = 400_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lengths:
    """Token counts of texts; encodes each distinct piece once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode, self.cut = (lambda texts: list(map(len, library.encode(texts, num_threads=1)))), False
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.encode = lambda texts: list(map(len, library.encode_batch_fast(texts, add_special_tokens=False)))
            self.cut = _starts_words_at_spaces(path)
        self.known: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces (as they follow a space) in batches of about BATCH_BYTES."""
        batch, size = [], 0
        for piece in pieces:
            batch.append(piece)
            size += len(piece) + 1
            if size >= BATCH_BYTES:
                self.known.update(zip(batch, self.encode([" " + x for x in batch])))
                batch, size = [], 0
        if batch:
            self.known.update(zip(batch, self.encode([" " + x for x in batch])))

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.cut:
            return [n for part in _balanced(texts) for n in self.encode(part)]
        pieces = [SAFE.split(text) for text in texts]
        new = {x for row in pieces for x in row[1:]}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        else:
            new -= self.known.keys()
        self.learn(new)
        heads = [n for part in _balanced([row[0] for row in pieces]) for n in self.encode(part)]
        return [head + sum(map(self.known.__getitem__, row[1:])) for head, row in zip(heads, pieces)]


def _balanced(texts: list[str]):
    batch, size = [], 0
    for text in texts:
        batch.append(text)
        size += len(text)
        if size >= BATCH_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _starts_words_at_spaces(path: str) -> bool:
    """Whether the file is a byte-level tokenizer with no normalizer and the usual word pattern."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    before = model.get("pre_tokenizer") or {}
    strips = any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in model.get("added_tokens", []))
    return (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not model.get("normalizer") and not strips)


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 1024, keep: tuple[str, ...] = ("doc_id",)
                 ) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) of every row.

    A null text counts as empty; equal rows are counted alike; no begin or end token is added, and special strings
    inside a text are taken as the library takes them by default. An empty table gives no row. ``path`` must be
    readable where tasks run.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}).schema

    def count(batches):
        lengths = Lengths(path)
        for block in blocks(batches, "_text", 4 << 20):
            texts = block.column(block.num_columns - 1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = pa.array(lengths(pc.fill_null(texts, "").to_pylist()), pa.int64())
            columns = [*block.columns[:-1], n_bytes, n_tokens]
            yield pa.RecordBatch.from_arrays(columns, [*block.schema.names[:-1], "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
