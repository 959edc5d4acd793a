"""Secrets in texts: given patterns, and further candidates told apart by who owns their values.

The base patterns find assignments, access keys and hexadecimal keys; their matches always count. Candidates of the other
kinds only count if their value looks live and belongs to few: over the whole corpus the distinct owners and
repositories of each value's hash are counted. A value that several owners have is a widely copied example.

Values leave a task as hashes. The counts are aggregates that combine rows before they are exchanged. Values with
more than one thousandth of all candidates, at most a thousand of them, return by broadcast, the others by a join, so
a value that a third of all texts holds loads no single task.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .columns import set_aside
from .store import discard, stored
from .words import blocks

# Base patterns in the order in which spans are listed; the least length is that of the number's group.
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Kinds that the method adds: pattern and the group that is the value. The last is for values that no other kind matches.
ADDED = {
    "code_host": (r"(?:gh[pousr]|github_pat|glpat)[_-]([A-Za-z0-9_-]{20,})", 1),
    "chat": (r"xox[abeoprs]-([A-Za-z0-9-]{10,})", 1),
    "cloud": (r"AIza([A-Za-z0-9_-]{30,})", 1),
    "service": (r"(?:sk|rk|pk)_(?:live|test)_([A-Za-z0-9]{16,})", 1),
    "signed": (r"eyJ[A-Za-z0-9_-]{8,900}\.eyJ[A-Za-z0-9_-]{8,900}\.([A-Za-z0-9_-]{8,})", 1),
    "bearer": (r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,})", 1),
    "login": (r"""://[^\s:/@'"]+:([^\s:/@'"]{6,})@""", 1),
    "private": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]{40,})-----END [A-Z ]*PRIVATE KEY-----", 1),
    "opaque": (r"[A-Za-z0-9+/_-]{32,}={0,2}", 0),
}
KINDS = (*BASE, *ADDED)
#: A value of more owners, or of more repositories, is an example that was copied.
MOST_OWNERS, MOST_REPOSITORIES = 1, 20
#: Values with more than this share of all candidates (numerator 1) are sent to all tasks.
HOT_SHARE = 1000
#: Words that placeholders are made of.
PLACEHOLDERS = ("example", "sample", "placeholder", "changeme", "your", "dummy", "xxxx", "test")

_FOUND = "array<struct<kind:int,start:bigint,end:bigint,value:string,live:boolean>>"


def _compiled():
    """The assignment's name in either case, as ASCII letters only; hexadecimal digits as whole stretches of the least length."""
    base = {k: (re.compile(f"(?ai:{p})" if k == "assign" else p), g, n) for k, (p, g, n) in BASE.items()}
    base["hex"] = (re.compile(r"[0-9a-f]{24,}"), 0, 24)  # maximal stretches of 24 and more are those that remain
    return base, {k: (re.compile(p), g) for k, (p, g) in ADDED.items()}


def looks_live(value: str, kind: str) -> bool:
    """Whether a value looks drawn at random: no placeholder, varied characters and, if it has no prefix of its kind, letters in
    both cases and digits."""
    low = value.lower()
    if any(p in low for p in PLACEHOLDERS) or len(set(value)) < min(10, len(value) * 2 // 3):
        return False
    if kind == "opaque":
        return any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value) and any("0" <= c <= "9" for c in value)
    return True


def _free(taken: list[tuple[int, int]]):
    """A test whether a span meets none of the taken ones."""
    taken = sorted(taken)
    starts = [s for s, _ in taken]
    ends = list(itertools.accumulate((e for _, e in taken), max))
    return lambda start, end: not (i := bisect.bisect_left(starts, end)) or ends[i - 1] <= start


def found(text: str, base, added) -> list[tuple[int, int, int, str, bool]]:
    """Matches of one text: number of the kind, start and end in code points, hash of the value, whether it looks live.

    Added kinds leave out what a base match covers, opaque values what any other kind matches.
    """
    out, others = [], []
    for number, (kind, (pattern, group, least)) in enumerate(base.items()):
        out += [(number, m.start(), m.end(), m[group], kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    free = _free([(s, e) for _, s, e, _, _ in out])
    for number, (kind, (pattern, group)) in enumerate(added.items(), len(base)):
        free_here = free if kind != "opaque" else _free([(s, e) for _, s, e, _, _ in out + others])
        others += [(number, m.start(), m.end(), m[group], kind) for m in pattern.finditer(text) if free_here(m.start(), m.end())]
    return [(k, s, e, hashlib.sha256(v.encode()).hexdigest(), looks_live(v, kind)) for k, s, e, v, kind in out + others]


def _scan(batches):
    base, added = _compiled()
    kind = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("live", pa.bool_())])
    for block in blocks(batches):
        at = block.schema.get_field_index("text")
        rows = [found(t or "", base, added) for t in block.column(at).to_pylist()]
        offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
        columns = list(zip(*(m for r in rows for m in r))) or [()] * 5
        values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
        rest = [c for i, c in enumerate(block.columns) if i != at]
        names = [n for i, n in enumerate(block.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(offsets), values)], [*names, "found"])


def ownership(candidates: DataFrame) -> DataFrame:
    """``value``, ``n_rows``, and the distinct ``n_owners`` and ``n_repositories`` that have it; null counts as an owner."""
    of = candidates.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = of.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
    owners = by_owner.groupBy("value").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_owners"))
    repositories = of.groupBy("value", "repository").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count(F.lit(1)).alias("n_repositories"))
    return owners.join(repositories, "value")


def _with_ownership(candidates: DataFrame, owned: DataFrame, hot_share: int) -> DataFrame:
    """``candidates`` with the counts of their values, the frequent values' by broadcast."""
    total = owned.agg(F.sum("n_rows")).first()[0] or 0
    is_hot = F.col("n_rows") * hot_share > F.lit(total)  # fewer than hot_share values, by count
    hot = F.broadcast(owned.where(is_hot))
    met = candidates.join(hot, "value", "left")
    rest = met.where(F.col("n_rows").isNull()).select(*candidates.columns).join(owned.where(~is_hot), "value")
    return met.where(F.col("n_rows").isNotNull()).select(*rest.columns).unionByName(rest)


def _listed(matches: Column) -> Column:
    """``kind:start:end`` of matches by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda m: F.concat_ws(":", names[m["kind"]], m["start"].cast("string"), m["end"].cast("string"))), ",")


def scanned(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", most_owners: int = MOST_OWNERS,
            most_repositories: int = MOST_REPOSITORIES, hot_share: int = HOT_SHARE) -> DataFrame:
    """Every row without its text, with ``base`` and ``added`` (matches: kind's number in KINDS, start, end in code points, SHA-256 of
    the value, whether it looks live), ``n_copied`` (matches whose value has too many owners or repositories) and
    ``n_specific`` (the other live-looking ones).

    Base matches stay whatever their value. A match of an added kind is in ``added`` if it looks live, at most ``most_owners``
    distinct owners and ``most_repositories`` distinct repositories have its value, and no base match covers some of it. A
    null owner or repository is one of its own; a null text is empty. Equal rows are scanned alike and count once for their repository. An
    empty table gives no row. ``doc_id`` and ``source`` name the columns by default; columns with the names of results are replaced.
    """
    aside = set_aside(docs, {"repository": repository, "text": text} | ({"owner": owner} if owner != repository else {}))
    rows = aside.rows if owner != repository else aside.rows.withColumn("owner", F.col("repository"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"), f"found {_FOUND}"])
    seen = stored(rows.mapInArrow(_scan, schema).withColumn("row", F.monotonically_increasing_id()))
    candidates = seen.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("m")).select(
        "row", "owner", "repository", "m.*")
    owned = stored(ownership(candidates))
    judged = _with_ownership(candidates.select("row", "value", F.struct("kind", "start", "end", "value", "live").alias("m")), owned, hot_share)
    copied = (F.col("n_owners") > most_owners) | (F.col("n_repositories") > most_repositories)
    is_base = F.col("m.kind") < len(BASE)
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(is_base, F.col("m"))).alias("base"), F.collect_list(F.when(~is_base & F.col("m.live") & ~copied, F.col("m"))).alias("added"),
        F.count_if(copied).alias("n_copied"), F.count_if(~copied & F.col("m.live")).alias("n_specific"))
    none = F.from_json(F.lit("[]"), _FOUND)
    full = seen.drop("found").join(per_row, "row", "left").withColumns({
        "base": F.coalesce("base", none), "n_copied": F.coalesce("n_copied", F.lit(0)), "n_specific": F.coalesce("n_specific", F.lit(0)),
        "added": F.coalesce("added", none)})
    result = stored(full)
    discard(owned)
    discard(seen)
    if owner == repository:
        aside.own.pop("owner", None)
    return aside.back(result, ("base", "added", "n_copied", "n_specific"), without=(text,))


def n_of(kind: str) -> Column:
    """Base matches of a kind."""
    return F.size(F.filter("base", lambda m: m["kind"] == KINDS.index(kind))).cast("long")


def base_spans() -> Column:
    return _listed(F.col("base"))


def all_spans() -> Column:
    return _listed(F.concat("base", "added"))
