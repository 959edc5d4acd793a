"""Token alignment next to a byte-by-byte version with both libraries on whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings, strategies as st

from llm.cases import empty_frame, keeps_other_columns, odd_frame
from panelspark.llm import token_alignment as ta, tokens
from panelspark.llm.queries import QUERIES

A, B = (tokens.vocabulary_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
HARD = ["a", " ", "  ", "a  b", " a ", "añ 日本 🦄🦄 x", "🦄", "a▁b", "<|endoftext|> <s> <unk>", "\x00 nul", "line\nline\n\n line", " x　y", "é é",
        "tab\tand\r\nbreak", "x" * 3000, "don't 'll we've 12,345.67", "​﻿", "ก็ไม่", "a ▁ b", "\U0010ffff͸", " \n ", "İ ı ſ K"]


def library():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    alphabet = ta.byte_alphabet()
    names = {i: t for t, i in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def both(text):
        if not text:
            return [], []
        left = [(i, bytes(alphabet[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        want = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == want == b"".join(x for _, x in right) else ([], [])

    return both


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    both, seen, counts = library(), [], Counter()
    for text in texts:
        left, right = both(text)
        sides, owner = [], []
        for side in (left, right):
            sides.append(np.cumsum([len(x) for _, x in side]).tolist())
            owner.append([k for k, (_, x) in enumerate(side) for _ in x])
        links = sorted(set(zip(*owner)))
        ends = sorted(set(sides[0]) & set(sides[1]))
        place = [{e: k + 1 for k, e in enumerate(es)} for es in sides]
        groups, low = [], [0, 0]
        for end in ends:
            high = [p[end] for p in place]
            groups.append("|".join(",".join(str(i) for i, _ in side[lo:hi]) for side, lo, hi in zip((left, right), low, high)))
            low = high
        pairs = [(left[i][0], right[j][0]) for i, j in links]
        counts.update(pairs)
        seen.append((len(left), len(right), len(groups), pairs, ";".join(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(na, nb, ng, len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), g) for na, nb, ng, pairs, g in seen]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    want = [(i, *w[:6], sha(w[6])) for (i, _), w in zip(docs, brute([t for _, t in docs]))]
    got = QUERIES["op12_token_alignment"](spark, DATA)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(tuple, got.collect())) == want


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string").repartition(3)


def test_hard_texts(hard):
    want = brute(HARD)
    assert [tuple(r)[1:] for r in sorted(ta.aligned(hard, A, B).collect())] == [(*w[:6], sha(w[6])) for w in want]
    assert [r.groups for r in sorted(ta.token_groups(hard, A, B).collect())] == [w[6] for w in want]
    assert want[HARD.index("a▁b")] == (0,) * 6 + ("",) and want[HARD.index("🦄")][0] > 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é日🦄\n\t'1.▁<>s "), max_size=40), min_size=1, max_size=6))
def test_any_pieces(texts):
    aligner = ta.Aligner(A, B)
    rows = [aligner.pieces(t) if t else [] for t in texts]
    aligner.learn({p for r in rows for p in r})
    good, counts, _, _ = aligner.table() if aligner.parts else (np.zeros(0, bool), np.zeros((4, 0)), None, None)
    for row, want in zip(rows, brute(texts)):
        at = [aligner.known[p] for p in row]
        ok = all(good[at])
        assert tuple(counts[:, at].sum(axis=1).tolist() if ok else [0] * 4) == want[:4]
        assert (";".join(aligner.groups[i] for i in at) if ok else "") == want[6]


def test_odd_documents_and_small_memory(spark, monkeypatch):
    docs = odd_frame(spark, clashes=True).where("coalesce(length(text), 0) < 100000")
    keep = tuple(c for c in docs.columns if c != "text")
    rows = ta.aligned(docs, A, B, keep=keep)
    assert keeps_other_columns(rows)
    texts = [r.text for r in docs.collect()]
    want = sorted((*w[:6], sha(w[6])) for w in brute(texts))
    assert sorted(tuple(r)[-7:] for r in rows.collect()) == want
    assert ta.aligned(empty_frame(spark), A, B).count() == 0


def test_memory_is_emptied_between_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ta, "REMEMBERED", 3)
    texts = [f"w{i} x{i}" for i in range(20)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in texts]
    chunks = [x for x in ta._read(batches, A, B, 1 << 20)]
    assert sum(block is None for _, block, _ in chunks) > 3 and sum(block is not None for _, block, _ in chunks) == 20


def test_coarse_cuts_are_refined():
    coarse, trusted = np.array([3, 6, 6, 6, 9]), np.array([True, False, False, True, True])
    assert ta.refined(coarse, trusted, np.array([3, 1, 1, 1, 3]), np.zeros(5, np.int64)).tolist() == [3, 4, 5, 6, 9]
    start = np.array([0, 0, 5, 5, 5])  # the second piece starts at 5 with tokens whose ends are unknown
    assert ta.refined(np.array([2, 5, 0, 0, 9]), np.array([True, True, False, False, True]), np.array([2, 3, 1, 2, 1]), start).tolist() == [2, 5, 6, 8, 9]
