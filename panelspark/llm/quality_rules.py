"""Quality rules with adaptive thresholds: quantile sketches per language and source in place of fixed cutoffs.

Every document gets exact counts and four integer rates. A sketch of a rate is a table of bins with counts: values
below 64 have bins of their own, larger ones keep their six leading bits, so a bin is at most 1/32 of its value
wide. Sketches merge by adding counts, which Spark does before it exchanges rows, so a source that holds a third of
all rows sends a few hundred rows per task. Fences stand outside the quartiles by a multiple of their distance;
documents are joined with the fences of their group and filtered.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .columns import set_aside
from .store import stored
from .words import blocks, groups, hashes, mixed, not_white, split, windows

#: rate -> (two-sided, least distance of the quartiles that counts)
RATES = {"word_length": (True, 30), "symbol_rate": (False, 20), "duplicate_line_rate": (False, 100),
         "repeat_rate": (False, 100)}
#: Fences stand this many quartile distances outside the quartiles.
REACH = 4
#: Groups of fewer documents take the fences of their language, and small languages those of all documents.
LEAST_DOCS = 30
#: Up to so many groups of language and source are sent to all tasks; more are joined by a shuffle.
MOST_FENCES = 100_000
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Exact counts per row of a text column."""
    words = split(column, not_white())
    n = len(column)
    per_row = lambda row: np.bincount(row, minlength=n).astype(np.int64)
    heads = np.r_[0, np.cumsum((words.data & 0xC0) != 0x80)]
    chars = heads[words.ends] - heads[words.starts]
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    symbols = np.r_[0, np.cumsum(symbol[words.data])]
    word_hash = hashes(words)

    no_break = np.ones(256, bool)
    no_break[0x0A] = False
    lines = split(column, no_break)
    filled = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    line_key = mixed(hashes(lines)[filled] ^ mixed(lines.row[filled].astype(np.uint64)))
    line_row = lines.row[filled]
    order, run = groups(line_key)

    at, window_hash = windows(word_hash, words.row, 3)
    worder, wrun = groups(mixed(window_hash ^ mixed(words.row[at].astype(np.uint64))))
    size = np.diff(np.r_[wrun, len(worder)])
    repeated = at[worder[np.repeat(size > 1, size)]]
    edge = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + 3, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return {"n_words": words.counts, "word_chars": np.bincount(words.row, chars, n).astype(np.int64),
            "n_symbols": np.bincount(words.row, symbols[words.ends] - symbols[words.starts], n).astype(np.int64),
            "n_dup_lines": per_row(line_row) - per_row(line_row[order[run]]), "n_repeat_words": per_row(words.row[covered]),
            "n_lines": per_row(line_row)}


def with_counts(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns but those with the names of counts, then the counts; the text only if it is kept."""
    rows = docs.drop(*(c for c in _COUNTS if c in docs.columns)).withColumnRenamed(text, "_text")
    rest = [c for c in rows.columns if c != "_text"]
    rows = rows.select(*rest, "_text")
    schema = (rows if keep_text else rows.drop("_text")).withColumns({c: F.lit(0).cast("long") for c in _COUNTS}).schema
    n_kept = len(rest) + keep_text

    def count(batches):
        for block in blocks(batches, "_text", 1 << 19):
            counts = text_counts(block.column(block.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*block.columns[:n_kept], *(pa.array(counts[c]) for c in _COUNTS)], schema.fieldNames())

    return rows.mapInArrow(count, schema).withColumnRenamed("_text", text)


def with_rates(counts: DataFrame) -> DataFrame:
    """Integer rates: hundredths of characters per word, and thousandths of words or lines."""
    per = lambda scale, a, b: F.expr(f"coalesce({scale} * {a} div nullif({b}, 0), 0)")
    return counts.withColumns({
        "word_length": per(100, "word_chars", "n_words"), "symbol_rate": per(1000, "n_symbols", "n_words"),
        "duplicate_line_rate": per(1000, "n_dup_lines", "n_lines"), "repeat_rate": per(1000, "n_repeat_words", "n_words")})


def bin_floor(value: Column) -> Column:
    """The least value of a value's bin: its six leading bits, the others zero."""
    spare = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def sketches(rated: DataFrame) -> DataFrame:
    """Bins and counts of every rate for each language and source, each language, and all rows (``level`` 0, 1, 3)."""
    rates = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), bin_floor(F.col(r)).alias("bin")) for r in RATES)))
    fine = rated.select("lang", "source", rates.alias("r")).groupBy("lang", "source", "r.rate", "r.bin").agg(
        F.count(F.lit(1)).alias("n"))
    merged = fine.groupingSets([["lang", "source", "rate", "bin"], ["lang", "rate", "bin"], ["rate", "bin"]],
                               "lang", "source", "rate", "bin")
    return merged.agg(F.sum("n").alias("n"), (F.grouping("lang") * 2 + F.grouping("source")).alias("level"))


def quantiles(sketch: DataFrame) -> DataFrame:
    """First and third quartile and number of rows of every sketch; a quantile is the floor of the bin it falls in."""
    key = ["level", "lang", "source", "rate"]
    ordered = W.partitionBy(*key).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    ranked = sketch.withColumns({"upto": F.sum("n").over(ordered), "total": F.sum("n").over(W.partitionBy(*key))})
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bin")))
    return ranked.groupBy(*key).agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("total"))


def fences(quartiles: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per language and source: ``<rate>_low`` and ``<rate>_high`` from its own, its language's or all rows' sketch."""
    aggs = []
    for rate, (two_sided, least) in RATES.items():
        span = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * reach
        here = F.col("rate") == rate
        low = F.col("q1") - span if two_sided else F.lit(0).cast("long")
        aggs += [F.max(F.when(here, low)).alias(f"{rate}_low"), F.max(F.when(here, F.col("q3") + span)).alias(f"{rate}_high")]
    wide = quartiles.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *aggs)
    names = [f"{rate}_{side}" for rate in RATES for side in ("low", "high")]
    own, language, whole = (wide.where(F.col("level") == level).select(
        *[F.col(c).alias(f"{c}{level}") for c in ("lang", "source")],
        F.struct("total", *names).alias(f"f{level}")) for level in (0, 1, 3))
    joined = own.join(language, F.col("lang0").eqNullSafe(F.col("lang1")), "left").join(whole, F.lit(True), "left")
    chosen = F.when(F.col("f0.total") >= least_docs, F.col("f0")).when(
        F.col("f1.total") >= least_docs, F.col("f1")).otherwise(F.col("f3")).alias("fence")
    return joined.select("lang0", "source0", chosen)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, text: str = "text", reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Every row of ``docs`` without its text, with counts, rates, ``base_failed`` and ``kept``.

    ``docs`` has ``lang`` and ``source``, either may be null and is then a group of its own. A null text has no
    words, so it fails. Fences come from rows that don't fail the base rules; when there is none, nothing else is
    left to judge. Equal rows are judged alike. Columns of the input with the names of results are replaced.
    """
    aside = set_aside(docs, {"lang": "lang", "source": "source", "text": text})
    rated = stored(_rated(aside.rows))
    return aside.back(_with_verdict(rated, _fence_table(rated, reach, least_docs)), (*_COUNTS, *RATES, "base_failed", "kept"), without=(text,))


def _rated(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    return with_rates(with_counts(rows, keep_text=keep_text)).withColumn("base_failed", base_failed())


def _fence_table(rated: DataFrame, reach: int, least_docs: int) -> DataFrame:
    return fences(quantiles(sketches(rated.where(~F.col("base_failed")))), reach, least_docs)


def _with_verdict(rated: DataFrame, fence: DataFrame) -> DataFrame:
    """``rated`` with ``kept``, by the fences of each row's language and source."""
    joined = rated.join(fence, F.col("lang").eqNullSafe(F.col("lang0")) & F.col("source").eqNullSafe(F.col("source0")), "left")
    inside = reduce(lambda a, b: a & b, [F.col(r).between(F.col(f"fence.{r}_low"), F.col(f"fence.{r}_high")) for r in RATES])
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def passing(docs: DataFrame, text: str = "text", reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns.

    One pass takes the counts that the fences come from, a second one counts again with the text at hand: texts stay in place, and only the fences are
    joined, by broadcast up to MOST_FENCES groups.
    """
    aside = set_aside(docs, {"lang": "lang", "source": "source", "text": text})
    rated = _rated(aside.rows.select("lang", "source", "text"))
    fence = stored(_fence_table(stored(rated.select("lang", "source", *RATES, "base_failed")), reach, least_docs))
    fence = F.broadcast(fence) if fence.count() <= MOST_FENCES else fence
    return aside.back(_with_verdict(_rated(aside.rows, keep_text=True), fence).where("kept"))
