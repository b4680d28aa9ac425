"""Rules against labels: confusion counts by slice, ratios, Wilson intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """Lower and upper bound, within 0..1; null for no trials."""
    p = F.try_divide(successes, total)
    z2 = Z * Z
    centre = p + z2 / (2 * total)
    spread = Z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total))
    base = 1 + z2 / total
    low, high = (centre - spread) / base, (centre + spread) / base
    none = F.lit(None).cast("double")
    return F.when(total > 0, F.round(F.greatest(F.lit(0.0), low), 6)).otherwise(none), F.when(total > 0, F.round(F.least(F.lit(1.0), high), 6)).otherwise(none)


def confusion(cases: DataFrame, expected: DataFrame, predicted: DataFrame, slices: tuple[str, ...] = ("language", "format")) -> DataFrame:
    """Counts over cases and the rules either side names, overall and by rule and slice.

    cases: (case_id, *slices), each case once; expected and predicted: (case_id, rule_id). Only the pairs one side
    names are joined; what neither names is the number of pairs a slice has in all less these, so cases and rules
    never meet as a product.
    """
    e = expected.select("case_id", "rule_id").distinct().withColumn("e", F.lit(True))
    p = predicted.select("case_id", "rule_id").distinct().withColumn("p", F.lit(True))
    named = e.join(p, ["case_id", "rule_id"], "full_outer").select("case_id", "rule_id", F.coalesce("e", F.lit(False)).alias("e"), F.coalesce("p", F.lit(False)).alias("p"))
    keys = ["rule_id", *slices]
    grouping = lambda *own: sum(0 if k in own else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys))
    n = lambda c: F.sum(c.cast("bigint"))
    sets = [[], [F.col("rule_id")], *[[F.col(s)] for s in slices]]
    seen = named.join(cases, "case_id").groupingSets(sets, *keys).agg(
        F.grouping_id().alias("g"), n(F.col("e") & F.col("p")).alias("tp"), n(~F.col("e") & F.col("p")).alias("fp"), n(F.col("e") & ~F.col("p")).alias("fn")
    )
    rules = named.select("rule_id").distinct()
    width, height = rules.agg(F.count("*").alias("width")), cases.agg(F.count("*").alias("height"))  # one row each
    blank = lambda own: [F.lit(None).cast("string").alias(k) if k not in own else F.col(k).cast("string").alias(k) for k in keys]
    pairs = F.col("width") * F.col("height")
    whole = width.crossJoin(height).select(F.lit(grouping()).alias("g"), *blank(()), pairs.alias("pairs"))
    whole = whole.unionByName(rules.crossJoin(height).select(F.lit(grouping("rule_id")).alias("g"), *blank(("rule_id",)), F.col("height").alias("pairs")))
    for s in slices:
        own = cases.groupBy(s).agg(F.count("*").alias("height")).crossJoin(width)
        whole = whole.unionByName(own.select(F.lit(grouping(s)).alias("g"), *blank((s,)), pairs.alias("pairs")))
    a, b = whole.alias("a"), seen.alias("b")
    same = F.col("a.g") == F.col("b.g")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    counts = {c: F.coalesce(F.col(f"b.{c}"), F.lit(0)) for c in ("tp", "fp", "fn")}
    rest = F.col("a.pairs") - counts["tp"] - counts["fp"] - counts["fn"]
    return a.join(b, same, "left").where("pairs > 0").select(*(F.col(f"a.{k}") for k in keys), *(c.alias(k) for k, c in counts.items()), rest.alias("tn"))


def metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    low, high = wilson(tp, tp + fp)
    return counts.select(
        "*", F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"),
        F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(F.try_divide(fp, fp + tn), 6).alias("false_positive_rate"), low.alias("precision_low"), high.alias("precision_high"),
    )


def differences(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """(case_id, missing, unexpected) rule ids of the cases that differ."""
    e = expected.groupBy("case_id").agg(F.collect_set("rule_id").alias("e"))
    p = predicted.groupBy("case_id").agg(F.collect_set("rule_id").alias("p"))
    none = F.array().cast("array<string>")
    both = e.join(p, "case_id", "full_outer").select("case_id", F.coalesce("e", none).alias("e"), F.coalesce("p", none).alias("p"))
    out = both.select("case_id", F.array_sort(F.array_except("e", "p")).alias("missing"), F.array_sort(F.array_except("p", "e")).alias("unexpected"))
    return out.where((F.size("missing") > 0) | (F.size("unexpected") > 0))
