"""URL filtering by given rules and, where none fits, by association rules mined from the URLs that the rules decide.

Everything is a DataFrame or SQL function. Labels are the verdicts of the given rules. URLs become sets of tokens
(host names, path parts and words in them); FP-growth mines combinations of tokens with a label, over all tokens above
the support and all of a URL's. A mined rule needs support and confidence, and goes when a rule with one token less is as
sure of the same label. Rules are posted under the token that fewest rules have: a URL looks up its own tokens and
tests the rules that it finds there, in a table sent with the query or, if there are many rules, by a join.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

#: verdict, rule (host and path); a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
#: Up to so many mined rules are sent with the query; more are joined, all of them in both cases.
SENT_RULES = 2_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_order(rules) -> list[tuple[str, str]]:
    """Rules with the one that wins first: the longest; of equal length that with the longer host, then a block."""
    return sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[0] != "block", r[1]))


def fitting(host_: Column, path_: Column, rules) -> tuple[Column, Column]:
    """The rule that wins and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in reversed(rule_order(rules)):
        of, _, start = text.partition("/")
        fits = ((host_ == of) | host_.endswith("." + of)) & path_.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def tokens(host_: Column, path_: Column) -> Column:
    """Distinct tokens: names of the host, parts of the path, and words in those parts."""
    some = lambda a: F.filter(a, lambda x: x != "")
    mark = lambda kind, a: F.transform(some(a), lambda x: F.concat(F.lit(kind), x))
    low = F.lower(path_)
    return F.array_distinct(F.concat(mark("host:", F.split(host_, r"\.")), mark("part:", F.split(low, "/")),
                                     mark("word:", F.split(low, r"[^\p{L}\p{N}]+"))))


def _classes(rows: DataFrame, min_support: float) -> DataFrame:
    """Frequent tokens that occur in the same URLs, as one: ``class``, ``members``, ``n`` URLs, and ``low`` and ``high``, the
    first and last label of these. Frequent tokens are bounded by the tokens of a URL over the support, whatever the table."""
    n = rows.count()
    counts = rows.select("row", "label", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("where"), F.min("label").alias("low"), F.max("label").alias("high"))
    return counts.where(F.col("n") >= min_support * n).groupBy("n", "where", "low", "high").agg(
        F.min("token").alias("class"), F.collect_list("token").alias("members")).withColumn("support", F.col("n") / F.lit(float(max(n, 1))))


def _combined(rows: DataFrame, classes: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules of FP-growth over all classes that have several labels, with every member of each class."""
    member = classes.select("class", F.explode("members").alias("token"))
    own = rows.select("row", F.explode("tokens").alias("token")).join(member, "token").groupBy("row").agg(F.collect_set("class").alias("own"))
    items = F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array(F.concat(F.lit("label:"), "label"))).alias("items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows.join(own, "row", "left").select(items))
    found = stored(model.associationRules.where(F.col("consequent")[0].startswith("label:")).where(
        ~F.exists("antecedent", lambda x: x.startswith("label:"))).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 7, 100).alias("label"), "confidence", "support"))
    smaller = found.select("tokens", "label", "confidence", F.explode("tokens").alias("x")).select(
        "tokens", "label", "confidence", F.array_remove("tokens", F.col("x")).alias("less"))
    general = found.select(F.col("tokens").alias("_less"), F.col("label").alias("_label"), F.col("confidence").alias("_confidence"))
    beaten = smaller.join(general, (F.col("less") == F.col("_less")) & (F.col("label") == F.col("_label")) &
                          (F.col("_confidence") >= F.col("confidence"))).select("tokens", "label").distinct()
    kept = found.join(beaten, ["tokens", "label"], "left_anti").select("*", F.explode("tokens").alias("class"))
    lists = kept.join(classes.select("class", "members"), "class").groupBy("tokens", "label", "confidence", "support").agg(
        F.collect_list("members").alias("members"))
    each = F.aggregate("members", F.array(F.array().cast("array<string>")), lambda done, more: F.flatten(
        F.transform(done, lambda d: F.transform(more, lambda t: F.concat(d, F.array(t))))))
    return lists.select(F.explode(each).alias("tokens"), "label", "confidence", "support").withColumn("tokens", F.array_sort("tokens"))


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """All rules from URLs with ``tokens`` and ``label``: ``tokens``, ``label``, ``confidence``, ``support`` and ``posted``, the
    token under which a rule is found; stored.

    Nothing frequent is left out of the mining. Two facts keep it small: of tokens in the same URLs a rule has one at most,
    since a second is no surer; and a token of one label is a rule by itself that beats all longer ones, so
    combinations are mined among the others. The work still doubles with each of those that a URL has.
    """
    rows = stored(labelled.select("label", "tokens").withColumn("row", F.monotonically_increasing_id()))
    classes = stored(_classes(rows, min_support))
    sure = classes.where("low = high")
    found = sure.select(F.explode("members").alias("token"), "low", "support").select(
        F.array("token").alias("tokens"), F.col("low").alias("label"), F.lit(1.0).alias("confidence"), "support")
    several = classes.where("low <> high")
    if not several.isEmpty():
        found = found.unionByName(_combined(rows, several, min_support, min_confidence))
    found = stored(found)
    each = found.select("*", F.explode("tokens").alias("token"))
    uses = each.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    return stored(each.join(uses, "token").groupBy(*found.columns).agg(F.min(F.struct("uses", "token"))["token"].alias("posted")))


def mined(labelled: DataFrame, **options) -> list[dict]:
    """``mined_rules`` as a list, the most certain first; for models of a size that the driver holds."""
    return _listed(mined_rules(labelled, **options))


def _listed(rules: DataFrame) -> list[dict]:
    return [r.asDict() for r in rules.orderBy(F.desc("confidence"), F.desc("support"), F.size("tokens"), "tokens", "label").collect()]


def matched(tokens_: Column, rules: list[dict]) -> Column:
    """Label of the most certain mined rule whose tokens the URL has; null where there is none."""
    if not rules:
        return F.lit(None).cast("string")
    index: dict = {}
    for place, r in enumerate(rules):  # rules come best first
        index.setdefault(r["posted"], []).append({"place": place, "tokens": r["tokens"], "label": r["label"]})
    posted = F.from_json(F.lit(json.dumps(index)), "map<string,array<struct<place:int,tokens:array<string>,label:string>>>")
    found = F.flatten(F.transform(tokens_, lambda t: F.coalesce(F.try_element_at(posted, t), F.array().cast(
        "array<struct<place:int,tokens:array<string>,label:string>>"))))
    fits = F.filter(found, lambda r: F.size(F.array_except(r["tokens"], tokens_)) == 0)
    return F.array_min(F.transform(fits, lambda r: F.struct(r["place"].alias("place"), r["label"].alias("label"))))["label"]


def joined(split: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path`` and ``mined``, the label that ``matched`` gives, of the URLs that some rule fits; by a join on posted tokens."""
    urls = split.select("host", "path").distinct().withColumn("known", tokens(F.col("host"), F.col("path")))
    met = urls.select("*", F.explode("known").alias("posted")).join(rules, "posted").where(F.size(F.array_except("tokens", "known")) == 0)
    order = F.struct(-F.col("confidence"), -F.col("support"), F.size("tokens").alias("size"), "tokens", "label")
    return met.groupBy("host", "path").agg(F.min(order)["label"].alias("mined"))


def judged(pages: DataFrame, rules=RULES, url: str = "url", default: str = "allow", **options) -> DataFrame:
    """All columns of ``pages`` and ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    The verdict is that of the longest given rule that fits, else that of the most certain mined rule, else
    ``default``. A null URL or one without ``://`` has an empty host and path and fits no rule. Without labelled URLs
    nothing is mined. Equal rows are judged alike; result columns replace columns of the same name.
    """
    split = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    rule, label = fitting(F.col("host"), F.col("path"), rules)
    known = tokens(F.col("host"), F.col("path"))
    labelled = stored(split.select(label.alias("label"), known.alias("tokens")).where("label is not null"))
    found = mined_rules(labelled, **options)
    split = split.withColumn("rule", rule)
    if found.count() <= SENT_RULES:
        return split.withColumn("verdict", F.coalesce(label, matched(known, _listed(found)), F.lit(default)))
    names = split.columns
    pairs = joined(split.where("rule is null"), found).withColumnsRenamed({"host": "of_host", "path": "of_path", "mined": "of_mined"})
    both = split.join(pairs, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    return both.withColumn("verdict", F.coalesce(label, "of_mined", F.lit(default))).select(*names, "verdict")
