"""Run statistics as Spark aggregations: totals, length histograms, errors and adjacent bases of adapters, expected matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.functions.reads import cut, interval
from readmill.plans.spec import Adapter, Linked, Single


def total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def summary(df: DataFrame, before: str, after: str, adapters: str | None = None, fate: str | None = None) -> DataFrame:
    """One row: reads, bp_in, with_adapter, written, bp_written. before/after: sequences; fate: 'written' marks what is written."""
    kept = F.lit(True) if fate is None else F.col(fate) == "written"
    found = F.lit(0) if adapters is None else (F.size(adapters) > 0).cast("long")
    return df.agg(
        F.count("*").alias("reads"), total(F.length(before)).alias("bp_in"), total(found).alias("with_adapter"), total(kept.cast("long")).alias("written"), total(F.when(kept, F.length(after))).alias("bp_written"),
    )


def length_histogram(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    return df.groupBy(F.length(sequence).alias("length")).agg(F.count("*").alias("reads"))


def fates(df: DataFrame, fate: str = "fate") -> DataFrame:
    return df.groupBy(fate).agg(F.count("*").alias("reads"))


def end_of(m: Column, sequence: Column) -> dict[str, Column]:
    """Of a match in a sequence: adapter, end (5p/3p), removed (letters), errors, adjacent (the base before a 3' adapter)."""
    three = m["side"] == "after"
    removed = F.when(three, m["to"] - m["from"] - m["rstart"]).otherwise(m["rstop"])
    base = F.upper(F.substring(cut(sequence, interval(m["from"], m["to"])), m["rstart"], F.lit(1)))
    adjacent = F.when(three, F.when((m["rstart"] > 0) & base.isin("A", "C", "G", "T"), base).otherwise(""))
    return {"adapter": m["adapter"], "end": F.when(three, "3p").otherwise("5p"), "removed": removed, "errors": m["errors"], "adjacent": adjacent}


def ends(df: DataFrame, matches: str = "matches", sequence: str = "sequence") -> DataFrame:
    """A row for each adapter part found."""
    exploded = df.select(F.col(sequence).alias("s"), F.explode(matches).alias("m"))
    return exploded.select(*(c.alias(n) for n, c in end_of(F.col("m"), F.col("s")).items()))


def adapter_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("adapter", "end", "removed", "errors").agg(F.count("*").alias("reads"))


def adjacent_bases(found: DataFrame) -> DataFrame:
    """adapter, adjacent, reads, share (of the adapter's 3' matches), suspicious: one base before more than 80 % of 20 or more."""
    counts = found.where("end = '3p'").groupBy("adapter", "adjacent").agg(F.count("*").alias("reads"))
    all_of = counts.groupBy("adapter").agg(F.sum("reads").alias("n"))
    share = F.col("reads") / F.col("n")
    return counts.join(all_of, "adapter").select("adapter", "adjacent", "reads", share.alias("share"), ((share > 0.8) & (F.col("n") >= 20) & (F.col("adjacent") != "")).alias("suspicious"))


def match_probabilities(adapter: Single, gc: float = 0.5) -> list[float]:
    """That a random read holds the first n letters of the adapter where it is joined to the read, for n from 0."""
    share = {"A": (1 - gc) / 2, "T": (1 - gc) / 2, "C": gc / 2, "G": gc / 2}
    sequence = adapter.sequence[::-1] if adapter.removes_before else adapter.sequence
    out = [1.0]
    for c in sequence:
        out.append(out[-1] * (1.0 if c == "N" and adapter.adapter_wildcards else share.get(c, 0.25)))
    return out


def expected_matches(histogram: DataFrame, adapters: Sequence[Adapter], reads: int, gc: float = 0.5) -> DataFrame:
    """adapter, end, removed, reads, expect (by chance), max_err, error_counts (by number of errors, from 0)."""
    rows = []
    for a in adapters:
        for part, end in ((a.front, "5p"), (a.back, "3p")) if isinstance(a, Linked) else ((a, "5p"), (a, "3p")):
            p = match_probabilities(part, gc)
            rows.append((a.name, end, p, len(part.sequence), part.effective_length, part.rate))
    plan = histogram.sparkSession.createDataFrame(rows, "adapter string, end string, p array<double>, size int, effective int, rate double")
    most = F.floor(F.col("rate") * F.least(F.col("removed"), F.col("effective"))).cast("int")
    by_length = histogram.groupBy("adapter", "end", "removed").agg(F.sum("reads").alias("reads"), F.map_from_entries(F.collect_list(F.struct("errors", "reads"))).alias("by_errors"), F.max("errors").alias("top"))
    counts = F.transform(F.sequence(F.lit(0), F.greatest(most, F.col("top"))), lambda e: F.coalesce(F.element_at("by_errors", e), F.lit(0)))
    return by_length.join(F.broadcast(plan), ["adapter", "end"]).select("adapter", "end", "removed", "reads", (F.lit(reads) * F.element_at("p", F.least(F.col("removed"), F.col("size")) + 1)).alias("expect"), most.alias("max_err"), counts.alias("error_counts"))


def error_ranges(adapter: Single) -> list[tuple[int, int]]:
    """(longest overlap, errors allowed up to it)."""
    m, ends_ = adapter.effective_length, []
    for e in range(1, int(m * adapter.rate) + 1):
        ends_.append(next(n for n in range(m + 1) if int(n * adapter.rate) >= e) - 1)
    return [(n, e) for e, n in enumerate([*ends_, m])]
