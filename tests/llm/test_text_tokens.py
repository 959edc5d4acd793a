import random

import pytest

from panelspark.llm import tokens as T

from llm.cases import empty_frame, odd_documents, odd_frame


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.vocabulary_path("byte_bpe_50k.json"))


def test_pieces_count_as_the_whole_text(library):
    rng = random.Random(1)
    bits = ["a", "Bc", " ", "  ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "é", "1", "23", ".", "!!", "日本", "\u0085", "\x1c", "\u00a0", "\u2028", "👍", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    got = T.Lengths(T.vocabulary_path("byte_bpe_50k.json"))(texts)
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_remembering_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    monkeypatch.setattr(T, "BATCH_BYTES", 8)
    lengths = T.Lengths(T.vocabulary_path("byte_bpe_50k.json"))
    texts = ["alpha beta gamma delta", "alpha beta", "", "epsilon alpha"]
    for _ in range(2):
        assert lengths(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_are_not_cut(name):
    lengths = T.Lengths(T.vocabulary_path(name))
    assert not lengths.cut and lengths(["Hello there world", ""])[0] >= 3


def test_odd_documents(spark, library):
    rows = T.token_counts(odd_frame(spark, clashes=True), T.vocabulary_path("byte_bpe_50k.json")).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_documents()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert T.token_counts(empty_frame(spark), T.vocabulary_path("byte_bpe_50k.json")).count() == 0
