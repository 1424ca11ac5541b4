"""Known vendor lists as DataFrames, and matching misread names against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperledger.functions.values import fold_case, fold_shapes
from paperledger.functions.vendors import SEED_VENDORS, _fold, learnable, word_distance
from paperledger.plans.lineage import cut_lineage, stored


def newest_logged_vendors(ledger: DataFrame, user: str = "user_id", n: int | None = None) -> DataFrame:
    """Vendors of each user's logged bills, the newest first in ``rank``; with ``n``, of the last ``n`` bills only."""
    newest = Window.partitionBy(user).orderBy(F.desc("confirmed_at"), F.desc("bill_id"))
    bills = ledger.filter(F.col("status").isin("logged", "paid"))
    if n is None:
        # Only the order of a user's names matters: one row for each name, combined before the shuffle.
        names = bills.groupBy(user, "vendor").agg(F.max(F.struct("confirmed_at", "bill_id")).alias("last"))
        order = Window.partitionBy(user).orderBy(F.desc("last"))
        return names.select(user, "vendor", F.row_number().over(order).alias("rank"))
    ranked = bills.select(user, "vendor", "confirmed_at", "bill_id", F.row_number().over(newest).alias("rank"))
    return ranked.filter(F.col("rank") <= n).select(user, "vendor", "rank")


def merge_known_vendors(learned: DataFrame, scope: str | None = None) -> DataFrame:
    """Seed names and learned names, one spelling per folded name, seed first.

    ``learned`` has ``vendor`` and ``rank`` (lower is kept) and, with ``scope``,
    the column that names belong to. Seed names then have a null scope, which
    means everyone's, also of those who have learned nothing yet.
    """
    keys = [scope] if scope else []
    seeds = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(v).alias("vendor")) for i, v in enumerate(SEED_VENDORS)])
    everyone = [F.lit(None).cast(learned.schema[scope].dataType).alias(scope)] if scope else []
    seeded = learned.sparkSession.range(1).select(*everyone, F.inline(seeds)).select(*keys, "vendor", F.lit(0).alias("tier"), "rank")
    names = learned.filter(learnable(F.col("vendor"))).select(*keys, "vendor", F.lit(1).alias("tier"), "rank")
    if scope:
        # A spelling of a seed name is the seed name.
        names = names.filter(F.col(scope).isNotNull() & ~fold_case(F.col("vendor")).isin([_fold(v) for v in SEED_VENDORS]))
    folded = seeded.unionByName(names).withColumn("folded", fold_case(F.col("vendor"))).filter("folded <> ''")
    # min_by combines before the shuffle, unlike a row_number over all spellings.
    first = F.min_by("vendor", F.struct("tier", "rank", "vendor"))
    return folded.groupBy(*keys, "folded").agg(first.alias("vendor"), F.min("tier").alias("tier"))


def _variants(word: Column) -> Column:
    """A word and every form of it with one letter left out."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
    )
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, cut).otherwise(F.array())))


def _indexed(names: DataFrame, keys: list[str]) -> DataFrame:
    """One row per name and word position."""
    return names.select(*keys, "name", "words", "folded", "n", F.posexplode("words").alias("pos", "word"))


def _alike(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """``word, key``: the different words that were asked for, and the listed ones within one edit of them.

    Such words share a form with at most one letter left out, so they meet by
    equality on such forms.
    """
    forms = lambda words, name: words.select(F.col("word").alias(name)).distinct().select(name, F.explode(_variants(F.col(name))).alias("form"))
    met = forms(asked, "word").join(forms(listed, "key"), "form")
    return met.filter(F.levenshtein("word", "key", 1) >= 0).select("word", "key").distinct()


def resolve_vendors(
    df: DataFrame, name: str, known: DataFrame, *, scope: str | None = None, into: str = "resolved_to"
) -> DataFrame:
    """Add the one known vendor nearest to ``name``, or null.

    The different words of both sides are compared first; names then meet by
    equality on the known words within one edit of their own. A name is looked up
    by the word position whose known words are rarest among the known names: any
    position finds every match, and a common first word then costs nothing. With
    ``scope``, known names whose scope is null belong to everyone: they are
    matched once for all scopes and ranked together with a scope's own names.
    """
    keys = [scope] if scope else []
    prepared = lambda d, c: d.select(
        *keys,
        F.col(c).alias("name"),
        fold_case(F.col(c)).alias("folded"),
        F.split(fold_shapes(F.col(c)), " ").alias("words"),
    ).withColumn("n", F.size("words"))

    asked = prepared(df.filter(F.col(name).isNotNull()).select(*keys, name).distinct(), name)
    asked = asked.filter("folded <> ''")
    listed = prepared(known.select(*keys, "vendor").filter("vendor is not null").distinct(), "vendor")

    # Both lists are distinct names only, and each feeds several joins below.
    asked, listed = cut_lineage(asked), cut_lineage(listed)
    if scope:
        own = _near(asked, listed.filter(F.col(scope).isNotNull()), keys)
        common = _near(asked.drop(scope).distinct(), listed.filter(F.col(scope).isNull()).drop(scope), [])
        matched = own.unionByName(asked.select(scope, "name").join(common, "name"))
    else:
        matched = _near(asked, listed, [])
    # A pair can meet on several forms; count each known name once.
    scored = matched.groupBy(*keys, "name", "d").agg(
        F.min("vendor").alias("vendor"), (F.min("vendor") != F.max("vendor")).alias("tied")
    )
    best = (
        scored.groupBy(*keys, "name")
        .agg(F.min_by(F.struct("vendor", "tied"), "d").alias("best"))
        .filter("not best.tied")
        .select(*keys, F.col("name").alias(name), F.col("best.vendor").alias(into))
    )
    return df.join(best, [*keys, name], "left").select(*df.columns, into)


def _near(asked: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """``name, vendor, d`` (and the keys) of the pairs within one edit in each word."""
    on = [*keys, "n", "pos", "key"]
    asked_words, listed_words = _indexed(asked, keys), _indexed(listed, keys).withColumnRenamed("word", "key")
    alike = stored(_alike(asked_words, listed_words.withColumnRenamed("key", "word")))
    asked_forms = asked_words.join(alike, "word", "left").drop("word")
    listed_words = listed_words.join(alike.select("key").distinct(), "key", "left_semi")
    frequency = listed_words.groupBy(*on).agg(F.count("*").alias("hits"))
    # Cheapest position per asked name; a position without hits rules it out.
    costs = (
        asked_forms.join(frequency, on, "left")
        .groupBy(*keys, "name", "pos")
        .agg(F.sum(F.coalesce("hits", F.lit(0))).alias("cost"))
        .groupBy(*keys, "name")
        .agg(F.min(F.struct("cost", "pos")).alias("best"))
        .filter("best.cost > 0")
        .select(*keys, "name", F.col("best.pos").alias("pos"))
    )
    lookup = asked_forms.join(costs.hint("merge"), [*keys, "name", "pos"])  # as many rows as names, which packed look small enough to broadcast
    right = listed_words.select(*on, F.col("name").alias("vendor"), F.col("words").alias("known_words"), F.col("folded").alias("known_folded"))
    matched = (
        lookup.join(right, on)
        .filter(F.col("folded") != F.col("known_folded"))
        .withColumn("d", word_distance(F.col("words"), F.col("known_words")))
        .filter("d is not null")
    )
    return matched.select(*keys, "name", "vendor", "d")
