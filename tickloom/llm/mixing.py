"""Mixing sources to target weights by hierarchical budgets.

Weights go down a tree of domain, language and source. A node's budget is shared among its children by
weight; a child that can't use its share (its tokens times the largest number of epochs) is filled, and what
is left goes to its siblings by weight; only what all of them can't use stays with the ancestor, whose own
siblings get it. As a node's capacity is that of its leaves, this is one pass from the root down. All shares
are whole numbers.

A leaf takes whole epochs of its documents and then, in the order of a seeded hash of epoch and document, the
longest prefix of documents within the rest of its tokens. The prefix is stated as the first hash that is
left out, so documents are chosen by a comparison with a row per leaf. To find it, tokens are summed per leaf
and leading hash digits, and only the documents with the digits where the sum passes the rest are ordered: a
leaf with a third of all documents is no single group.

Defined cases: a null domain, language or source is the empty name; a null text has no tokens; rows with the
same doc_id and leaf share a hash and are taken or left together; an empty table gives an empty result; other
columns are kept by ``apply``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import plain_columns, stored

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3
LEAF = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Mix:
    """Weights are whole numbers. ``share`` of all tokens is the budget, as a fraction (over, under)."""

    domain: Column
    domain_weight: Column
    lang_weight: Column
    source_weight: Column
    share: tuple[int, int] = (1, 1)
    epochs: int = 2
    seed: int = 17


def default_mix() -> Mix:
    """Four domains by source number, one to four parts; English five parts, German and French two, others one; sources equal."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]{1,9})", 1).try_cast("long"), F.lit(0))
    lang = F.coalesce("lang", F.lit(""))
    return Mix(
        domain=F.concat(F.lit("domain"), F.pmod(number, F.lit(4))),
        domain_weight=F.substring("domain", 7, 1).cast("long") + 1,
        lang_weight=F.when(lang == "en", 5).when(lang.isin("de", "fr"), 2).otherwise(1).cast("long"),
        source_weight=F.lit(1).cast("long"),
    )


def _leafed(docs: DataFrame, mix: Mix) -> DataFrame:
    named = docs.withColumn("_domain", F.coalesce(mix.domain, F.lit("")))
    return named.withColumn("_lang", F.coalesce(F.col("lang").cast("string"), F.lit(""))).withColumn("_source", F.coalesce(F.col("source").cast("string"), F.lit("")))


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _fill(level: DataFrame, parent: list[str], child: str, budget: str) -> DataFrame:
    """Shares ``budget`` of each parent among its children (child, weight, capacity): column ``share``."""
    mine = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # children by capacity / weight: those that are filled come first
    before = mine.orderBy((F.col("capacity") / F.col("weight")), child).rowsBetween(Window.unboundedPreceding, -1)
    sums = level.withColumns({
        "_c": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "_w": F.coalesce(F.sum("weight").over(before), F.lit(0)), "_all": F.sum("weight").over(mine),
    }).withColumn("_full", (F.col(budget) - F.col("_c")) * F.col("weight") >= F.col("capacity") * (F.col("_all") - F.col("_w")))
    sums = sums.withColumns({
        "_fc": F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(mine), F.lit(0)), "_fw": F.coalesce(F.sum(F.when(F.col("_full"), F.col("weight"))).over(mine), F.lit(0)),
    })
    part = F.expr(f"(weight * ({budget} - _fc)) div (_all - _fw)")
    return sums.withColumn("share", F.when(F.col("_full"), F.col("capacity")).otherwise(part).cast("long")).drop("_c", "_w", "_all", "_full", "_fc", "_fw")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with the budget of each."""
    sized = leaves.withColumn("capacity", F.col("tokens") * mix.epochs)
    total = Window.partitionBy(F.lit(0))
    over, under = mix.share
    domains = sized.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", mix.domain_weight)
    domains = domains.withColumn("budget", F.expr(f"(sum(tokens) over (partition by 0) * {over}) div {under}")).withColumn("budget", F.least("budget", F.sum("capacity").over(total)))
    domains = _fill(domains, [], "domain", "budget").select("domain", F.col("share").alias("budget"))
    langs = sized.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", mix.lang_weight).join(domains, "domain")
    langs = _fill(langs, ["domain"], "lang", "budget").select("domain", "lang", F.col("share").alias("budget"))
    out = sized.withColumn("weight", mix.source_weight).join(langs, ["domain", "lang"])
    return _fill(out, ["domain", "lang"], "source", "budget").select(*LEAF, "tokens", F.col("share").alias("budget"))


def plan(docs: DataFrame, mix: Mix) -> DataFrame:
    """A row per leaf: tokens, budget, whole epochs, and the first hash left out of the next epoch (null: none)."""
    rows = _leafed(docs, mix).select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n"))
    rows = stored(rows, "mixing-rows")
    leaves = leaf_budgets(rows.groupBy(*LEAF).agg(F.sum("n").alias("tokens")), mix)
    leaves = leaves.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("long"))
    leaves = stored(leaves.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "mixing-leaves")
    keyed = rows.join(leaves, LEAF).withColumn("key", _key(mix.seed, F.col("epochs") + 1)).withColumn("digits", F.substring("key", 1, DIGITS))
    keyed = stored(keyed.select(*LEAF, "n", "rest", "key", "digits"), "mixing-keys")
    upto = Window.partitionBy(*LEAF).orderBy("digits")
    sums = keyed.groupBy(*LEAF, "digits").agg(F.sum("n").alias("s"), F.first("rest").alias("r")).withColumn("through", F.sum("s").over(upto))
    edge = sums.where("through > r").groupBy(*LEAF).agg(F.min_by(F.struct("digits", (F.col("through") - F.col("s")).alias("before")), "digits").alias("e"))
    inside = keyed.join(edge.select(*LEAF, F.col("e.digits").alias("digits"), F.col("e.before").alias("before")), [*LEAF, "digits"])
    running = F.col("before") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    bound = inside.withColumn("sofar", running).where("sofar > rest").groupBy(*LEAF).agg(F.min("key").alias("left_out"))
    return leaves.join(bound, LEAF, "left").select(*LEAF, "tokens", "budget", "epochs", "left_out")


def apply(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with _domain, _lang, _source and _copies, how often each document is in the mix (0: not at all)."""
    leaves = stored(plan(docs, mix), "mixing-plan").select(F.col("domain").alias("_domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("epochs").alias("_epochs"), F.col("left_out").alias("_left_out"))
    joined = _leafed(docs, mix).join(leaves, ["_domain", "_lang", "_source"])
    key = _key(mix.seed, F.col("_epochs") + 1)
    # only a leaf whose documents have no tokens has no bound: it is taken once
    more = F.when(F.col("_left_out").isNull() | (key < F.col("_left_out")), 1).otherwise(0)
    return joined.withColumn("_copies", (F.col("_epochs") + more).cast("int")).drop("_epochs", "_left_out")


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` in the mix, a row for each time a document is taken."""
    return plain_columns(docs, lambda plain: _mixed(plain, mix))


def _mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    taken = apply(docs, mix).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
