"""Documents that every text operator has to stand: nulls, blanks, repeated rows, a very long text, clashing names."""

import re

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Names that operators give to results or use inside.
CLASHES = ["n_words", "size", "kept", "fp", "key", "members", "other_1", "_text", "p", "a.b", "hit_items", "chunk", "target"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WHITE.findall(text or "")


def sentence(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


def odd_documents():
    """(doc_id, text, lang, source, n_chars)"""
    long = sentence(5, 60_000) + "\n" + "x" * 200_000 + "\n" + sentence(6, 60_000)
    texts = [None, "", " \t\n\x0b ", "one", "One two\tthree", sentence(1, 80), sentence(1, 80), sentence(1, 80) + " tail",
             "é ñ ü " * 30, "a b  c", long, sentence(2, 13), sentence(2, 12), "<|endoftext|> # | & 'll 's  x", "\x00\x01 nul"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, sentence(1, 80), "en", "s1", 5), (None, sentence(1, 80), "en", "s1", 0), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_frame(spark, clashes=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)
    return df.select("*", *(F.lit(f"other {c}").alias(c) for c in CLASHES)) if clashes else df


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)


def keeps_other_columns(df, results=()):
    """Whether the clashing columns still have what they had, but those that results replace."""
    row = df.first().asDict()
    return set(CLASHES) <= set(row) and all(row[c] == f"other {c}" for c in CLASHES if c not in results)
