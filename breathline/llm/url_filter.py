"""URL filter: fixed host and path rules, and association rules mined by FP-growth from the urls that they judge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breathline.llm.shared import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "label=block", "label=allow"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. ``rules``: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the longest is tested first, so it is added last
    for says, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: each host label with its place from the right, each path part; digits read as one ``0``."""
    labels = F.array_remove(F.split(host, r"\."), "")
    named = F.transform(labels, lambda x, i: F.concat(F.lit("host"), F.least(F.size(labels) - i, F.lit(4)).cast("string"), F.lit("="), x))
    parts = F.array_remove(F.split(path, "[/._=&-]+"), "")
    return F.array_distinct(F.concat(named, F.transform(parts, lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0")))))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float) -> DataFrame:
    """(rule_id, tokens, confidence, support, blocks) mined from (tokens, verdict); a rule that a shorter one makes needless is pruned."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("label="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.select(
        F.sort_array("antecedent").alias("tokens"), F.element_at("consequent", 1).alias("says"), "confidence", "support", "lift"
    ).where(F.col("says").isin(BLOCK, ALLOW) & (F.col("lift") >= min_lift) & ~F.exists("tokens", lambda t: t.isin(BLOCK, ALLOW)))
    found = found.select(F.xxhash64("tokens", "says").alias("rule_id"), "tokens", "confidence", "support", (F.col("says") == BLOCK).alias("blocks"))
    # a rule is needless if some rule without one of its tokens (any number left out, one at a time) is as confident
    shorter = found.where(F.size("tokens") > 1).select(
        "rule_id", "blocks", F.col("confidence").alias("least"),
        F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("tokens"),
    )
    needless = shorter.join(found.select("tokens", "blocks", "confidence"), ["tokens", "blocks"]).where("confidence >= least").select("rule_id")
    return found.join(needless, "rule_id", "left_anti")


def url_filter(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    work: Workspace,
    id_col: str = "page_id",
    url_col: str = "url",
    min_support: float = 0.002,
    min_confidence: float = 0.9,
    min_lift: float = 1.05,
) -> DataFrame:
    """One row per page: host, path, the fixed rule that fits (or null) and the verdict.

    Pages that a fixed rule judges are the labels. FP-growth counts their
    token sets; rules towards ``block`` or ``allow`` are pruned by support,
    confidence, lift and needlessness. A url without a fixed rule is blocked
    if the most confident mined rule whose tokens it all has says so (equal
    confidence: the better supported, then ``allow``); without one it is
    allowed. Matching goes by an inverted index: rule tokens join url tokens,
    and a rule fits when all its tokens were found.

    Urls are judged once per distinct (host, path). Null urls and urls without
    ``://`` have an empty host and path, no tokens and are allowed; repeated
    pages stay repeated; other columns are not read; an empty table gives an
    empty result; without labels no rule is mined. ``rules`` is a list given
    by the caller. Mined item sets are bounded by ``min_support``.
    """
    split = pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    judged = split.select("*", rule.alias("rule"), verdict.alias("_fixed"))
    labelled = work.write(judged.where("rule IS NOT NULL").select(url_tokens(F.col("host"), F.col("path")).alias("tokens"), F.col("_fixed").alias("verdict")))
    mined = work.write(mine_rules(labelled, min_support, min_confidence, min_lift))
    index = mined.select("rule_id", "blocks", "confidence", "support", F.size("tokens").alias("_needs"), F.explode("tokens").alias("token"))
    open_urls = judged.where("rule IS NULL").select("host", "path").distinct()
    found = (
        open_urls.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
        .join(index, "token")
        .groupBy("host", "path", "rule_id")
        .agg(F.count("*").alias("_has"), *[F.first(c).alias(c) for c in ("_needs", "blocks", "confidence", "support")])
        .where("_has = _needs")
        .select("host", "path", "blocks", (F.col("confidence") + 1e-3 * F.col("support")).alias("_weight"))
        .groupBy("host", "path")
        .agg(F.max(F.when(F.col("blocks"), F.col("_weight"))).alias("_block"), F.max(F.when(~F.col("blocks"), F.col("_weight"))).alias("_allow"))
    )
    blocked = found.where("_block > coalesce(_allow, 0)").select("host", "path", F.lit("block").alias("_mined"))
    return judged.join(blocked, ["host", "path"], "left").select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_fixed", "_mined", F.lit("allow")).alias("verdict")
    )
