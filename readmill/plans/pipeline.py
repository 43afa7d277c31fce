"""Run options to a DataFrame: cut, quality, adapters, poly-A, N ends, shorten, names, then one fate for each read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.functions import reads as R
from readmill.operators import trim as T
from readmill.plans.spec import Adapter


@dataclass(frozen=True)
class Trimming:
    """What happens to the reads of one side. Cutoffs of 0 and None switch a step off."""

    cuts: tuple[int, ...] = ()
    quality: tuple[int, int] = (0, 0)
    nextseq: int | None = None
    quality_base: int = 33
    adapters: Sequence[Adapter] = ()
    times: int = 1
    action: str = "trim"
    rc: bool = False
    poly_a: bool = False
    trim_n: bool = False
    shorten: int | None = None
    length_tag: str | None = None
    strip_suffixes: tuple[str, ...] = ()
    prefix: str = ""
    suffix: str = ""
    rename: str | None = None
    zero_cap: bool = False


@dataclass(frozen=True)
class Filters:
    """Predicates in the order in which they take reads. None switches one off."""

    min_length: int | None = None
    max_length: int | None = None
    max_n: float | None = None
    max_expected_errors: float | None = None
    max_error_rate: float | None = None
    casava: bool = False
    discard_trimmed: bool = False
    discard_untrimmed: bool = False
    quality_base: int = 33

    def steps(self, name: Column, sequence: Column, qualities: Column, matches: Column) -> list[tuple[str, Column]]:
        out: list[tuple[str, Column]] = []
        if self.min_length is not None:
            out.append(("too_short", R.too_short(sequence, self.min_length)))
        if self.max_length is not None:
            out.append(("too_long", R.too_long(sequence, self.max_length)))
        if self.max_n is not None:
            out.append(("too_many_n", R.too_many_n(sequence, self.max_n)))
        if self.max_expected_errors is not None:
            out.append(("too_many_expected_errors", R.too_many_errors(qualities, self.max_expected_errors, self.quality_base)))
        if self.max_error_rate is not None:
            out.append(("too_high_average_error_rate", R.too_high_error_rate(qualities, self.max_error_rate, self.quality_base)))
        if self.casava:
            out.append(("casava_filtered", R.casava_filtered(name)))
        if self.discard_trimmed:
            out.append(("discard_trimmed", F.size(matches) > 0))
        if self.discard_untrimmed:
            out.append(("discard_untrimmed", F.size(matches) == 0))
        return out


@dataclass(frozen=True)
class Options:
    first: Trimming = field(default_factory=Trimming)
    second: Trimming | None = None
    filters: Filters = field(default_factory=Filters)
    second_filters: Filters | None = None
    pair_filter: str = "any"
    pair_adapters: bool = False
    combined: bool = False  # the pair filter joins the reads' verdicts over all predicates, not predicate by predicate


def _span(df: DataFrame, span: Column) -> DataFrame:
    held = T.free_name(df, "_cut")
    df = df.withColumn(held, F.coalesce(span, R.interval(0, F.length("sequence"))))
    return df.withColumns({c: R.cut(F.col(c), F.col(held)) for c in ("sequence", "qualities")}).drop(held)


def trimmed(df: DataFrame, how: Trimming) -> DataFrame:
    """name, sequence, qualities after all modifiers; adds original (sequence), matches, cut_prefix, cut_suffix, is_rc, and the letters
    that went by quality and poly-A trimming. `searched` is the sequence in which adapters were looked for."""
    if "matches" in df.columns:
        df = df.drop("matches")
    df = df.withColumns({"original": F.col("sequence"), "cut_prefix": F.lit(""), "cut_suffix": F.lit(""), "is_rc": F.lit(False), "quality_trimmed": F.lit(0), "poly_a_trimmed": F.lit(0)})
    before = T.free_name(df, "_before")
    gone = F.col(before) - F.length("sequence")
    for n in how.cuts:
        df = df.withColumn("cut_prefix" if n > 0 else "cut_suffix", R.removed_end(F.col("sequence"), n))
        df = _span(df, R.cut_ends(F.col("sequence"), n))
    if how.nextseq is not None or any(how.quality):
        df = df.withColumn(before, F.length("sequence"))
    if how.nextseq is not None:
        df = _span(df, R.nextseq_span(F.col("sequence"), F.col("qualities"), how.nextseq, how.quality_base))
    elif any(how.quality):
        df = _span(df, R.quality_span(F.col("qualities"), *how.quality, how.quality_base))
    if how.nextseq is not None or any(how.quality):
        df = df.withColumn("quality_trimmed", gone).drop(before)
    if how.rc and how.adapters:
        df = T.best_strand(df.drop("is_rc"), how.adapters, how.times)
    else:
        df = T.find_adapters(df, how.adapters, how.times)
    df = T.apply_action(df.withColumn("searched", F.col("sequence")), how.action)
    if how.poly_a:
        df = _span(_span(df.withColumn(before, F.length("sequence")), R.poly_span(F.col("sequence"), head=True)), R.poly_span(F.col("sequence")))
        df = df.withColumn("poly_a_trimmed", gone).drop(before)
    if how.trim_n:
        df = _span(df, R.n_ends_span(F.col("sequence")))
    if how.shorten is not None:
        df = _span(df, R.shorten(F.col("sequence"), how.shorten))
    name = F.col("name")
    if how.length_tag:
        name = R.length_tag(name, how.length_tag, F.col("sequence"))
    for s in how.strip_suffixes:
        name = R.strip_suffix(name, s)
    if how.prefix or how.suffix:
        name = R.add_affixes(name, how.prefix, how.suffix, F.col("matches"))
    if how.rename:
        name = R.rename(how.rename, R.rename_columns(name, F.col("matches"), F.col("cut_prefix"), F.col("cut_suffix"), F.col("is_rc")))
    df = df.withColumn("name", name)
    return df.withColumn("qualities", R.zero_cap(F.col("qualities"), how.quality_base)) if how.zero_cap else df


def run(df: DataFrame, options: Options) -> DataFrame:
    """Single reads with their fate."""
    out = trimmed(df, options.first)
    return out.withColumn("fate", R.fate(options.filters.steps(F.col("name"), F.col("sequence"), F.col("qualities"), F.col("matches"))))


def run_pairs(df: DataFrame, options: Options) -> DataFrame:
    """Pairs (r1, r2 structs): each side trimmed, one fate for both. Adds matches1 and matches2."""
    second = options.second or replace(options.first, adapters=())
    sides = (("r1", "1", options.first), ("r2", "2", second))
    fields = ("name", "sequence", "qualities", "original", "matches", "cut_prefix", "cut_suffix", "is_rc", "quality_trimmed", "poly_a_trimmed", "searched")
    if options.pair_adapters:
        df = df.select("*", F.col("r1.sequence").alias("sequence1"), F.col("r2.sequence").alias("sequence2"))
        df = T.pair_adapters(df, options.first.adapters, second.adapters).drop("sequence1", "sequence2")
    for struct, k, how in sides:
        flat = df.select("*", *(F.col(f"{struct}.{c}").alias(c) for c in ("name", "sequence", "qualities")))
        if options.pair_adapters:
            flat = T.apply_action(flat, how.action, matches=f"matches{k}").withColumn(f"_m{k}", F.col(f"matches{k}")).drop(f"matches{k}")
            flat = trimmed(flat, replace(how, adapters=())).drop("matches").withColumnRenamed(f"_m{k}", "matches")
            flat = flat.withColumns({c: F.col(f"{struct}.sequence") for c in ("original", "searched")})
        else:
            flat = trimmed(flat, how)
        kept = [c for c in df.columns if c not in (struct, f"matches{k}")]
        df = flat.select(*kept, F.struct("name", "sequence", "qualities").alias(struct), F.col("matches").alias(f"matches{k}"), *(F.col(c).alias(f"{c}{k}") for c in fields[3:] if c != "matches"))
    filters = (options.filters, options.second_filters or options.filters)
    each = [dict(f.steps(F.col(f"{s}.name"), F.col(f"{s}.sequence"), F.col(f"{s}.qualities"), F.col(f"matches{k}"))) for f, (s, k, _) in zip(filters, sides)]
    if options.combined:
        verdicts = [R.fate(list(e.items()), "written") for e in each]
        takes = R.pair_predicate(*(v != "written" if e else None for v, e in zip(verdicts, each)), options.pair_filter)
        first = F.when(verdicts[0] != "written", verdicts[0]).otherwise(verdicts[1])
        return df.withColumn("fate", F.lit("written") if takes is None else F.when(takes, first).otherwise("written"))
    names = list(dict.fromkeys([*each[0], *each[1]]))
    return df.withColumn("fate", R.fate([(n, R.pair_predicate(each[0].get(n), each[1].get(n), options.pair_filter)) for n in names]))
