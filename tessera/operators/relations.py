"""Item, property and reference relations: resolution, precedence, validation, fallback, closure, preference."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.staging import settled


def last_wins(df: DataFrame, keys: list[str], order: list[Column], take: list[str]) -> DataFrame:
    """keys and the columns of the last row by order; partial maxima are combined before the shuffle."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.max_by(c, place).alias(c) for c in take))


def item_properties(associations: DataFrame, properties: DataFrame) -> DataFrame:
    """file, item, kind and the value of the item's last property of a kind, colour precedence left to the caller.

    associations: file, item, record (the order of association records), pos (the order in a record), index (1-based); only the
    first record of an item counts. properties: file, place (1-based), kind, value.
    """
    first = associations.groupBy("file", "item").agg(F.min("record").alias("record"))
    own = associations.join(first.hint("merge"), ["file", "item", "record"])
    found = own.join(properties.withColumnRenamed("place", "index").hint("merge"), ["file", "index"])
    return last_wins(found, ["file", "item", "kind"], [F.col("pos")], ["value"])


def duplicate_keys(df: DataFrame, keys: list[str], rule: int) -> DataFrame:
    """Violation rows (rule, key, n) of keys that occur twice or more."""
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), name.alias("key"), "n")


def orphans(df: DataFrame, key: str, parents: DataFrame, parent: str, rule: int) -> DataFrame:
    """Violation rows (rule, key, n) of keys that have no parent."""
    return df.join(parents.select(F.col(parent).alias("__p")).hint("merge"), F.col(key) == F.col("__p"), "left_anti").groupBy(key).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), "n")


def first_violation(violations: DataFrame) -> DataFrame:
    """The violation of the smallest rule and key: what a parser that stops at its first error reports."""
    return violations.agg(F.min(F.struct("rule", "key", "n")).alias("v")).where("v is not null").select("v.*")


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Different rows of first, and those of second whose keys first has none of."""
    return first.union(second.join(first.select(*keys).distinct().hint("merge"), keys, "left_anti").select(*first.columns)).distinct()


def closure(edges: DataFrame, roots: DataFrame, src: str, dst: str, root: str, most: int = 64) -> DataFrame:
    """root, node, depth: what each root reaches, itself included, at its least depth. Cycles end, since no node is entered twice.

    most bounds the depth; an error says that it was not enough, so nothing is lost. Each level is settled once and all are joined
    up at the end.
    """
    e = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d")).distinct()
    levels = [settled(roots.select(F.col(root).alias("root"), F.col(root).alias("node"), F.lit(0).alias("depth")).distinct(), "closure")]
    for depth in range(1, most + 1):
        step = levels[-1].join(e.hint("merge"), F.col("node") == F.col("__s")).select("root", F.col("__d").alias("node")).distinct()
        for seen in levels:
            step = step.join(seen.hint("merge"), ["root", "node"], "left_anti")
        front = settled(step.withColumn("depth", F.lit(depth)), "closure")
        if front.isEmpty():
            return functools.reduce(DataFrame.unionByName, levels)
        levels.append(front)
    raise RuntimeError(f"references are deeper than {most}")


def first_everywhere(groups: DataFrame, group: str, entity: str, place: str, other: str | None = None) -> DataFrame:
    """entity, preferred: whether it is the first of every group that holds it, or, with the column `other` (the same in all rows of
    an entity), of every group that holds both. Entities that share no group with theirs are preferred."""
    firsts = groups.groupBy(F.col(group).alias("__g")).agg(F.min_by(entity, place).alias("__first"), F.collect_set(entity).alias("__all"))
    first = F.col(entity) == F.col("__first")
    counts = F.lit(True) if other is None else F.array_contains("__all", F.col(other))
    return groups.join(firsts.hint("merge"), F.col(group) == F.col("__g")).groupBy(entity).agg(F.bool_and(first | ~F.coalesce(counts, F.lit(False))).alias("preferred"))


def unpivot_metadata(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, name, value: one row per named value that isn't null."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(key, F.inline(pairs)).where("value is not null")
