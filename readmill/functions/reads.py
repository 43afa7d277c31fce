"""Column functions on reads: sequences and qualities as strings of equal length, names as strings.

A trim is an interval, a struct (start, stop) counted from 0, until `cut` applies it to sequence and qualities alike, so the
two stay aligned. All of these are Columns: Catalyst expressions, but for the ones that look at every letter (quality and
poly-A trimming, expected errors, edit distances), which are Arrow UDFs over matrices of letters. Nulls give nulls.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from readmill.functions import letters

READ = "struct<name:string,sequence:string,qualities:string>"


def interval(start: Column | int, stop: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(start).cast("int").alias("start"), lit(stop).cast("int").alias("stop"))


def cut(value: Column, span: Column) -> Column:
    """The part of a string inside an interval."""
    return F.substring(value, span["start"] + 1, F.greatest(span["stop"] - span["start"], F.lit(0)))


def cut_ends(sequence: Column, n: int) -> Column:
    """Without the first n letters, or the last -n."""
    size = F.length(sequence)
    return interval(F.least(F.lit(n), size), size) if n >= 0 else interval(0, F.greatest(size + n, F.lit(0)))


def removed_end(value: Column, n: int) -> Column:
    """What `cut_ends` takes away."""
    return F.substring(value, 1, n) if n >= 0 else F.when(F.length(value) <= -n, value).otherwise(F.substring(value, n, -n))


def shorten(sequence: Column, n: int) -> Column:
    """The first n letters, or the last -n."""
    size = F.length(sequence)
    return interval(0, F.least(F.lit(n), size)) if n >= 0 else interval(F.greatest(size + n, F.lit(0)), size)


def quality_span(qualities: Column, front: int = 0, back: int = 0, base: int = 33) -> Column:
    """The interval left by running-sum quality trimming from both ends; (0, 0) if nothing is left."""
    return letters.quality_spans(front, back, base)(qualities)


def nextseq_span(sequence: Column, qualities: Column, cutoff: int, base: int = 33) -> Column:
    """Quality trimming of the 3' end in which a G counts as just below the cutoff whatever its quality."""
    return letters.nextseq_spans(cutoff, base)(sequence, qualities)


def poly_span(sequence: Column, head: bool = False) -> Column:
    """The interval without the poly-A tail (head: without the poly-T head): letters count 1, others -2, at most one in five may
    be another; tails under three letters stay."""
    return letters.poly_spans(head)(sequence)


def n_ends_span(sequence: Column) -> Column:
    """The interval without leading and trailing N."""
    size = F.length(sequence)
    start = size - F.length(F.ltrim(sequence, F.lit("Nn")))
    return interval(start, F.greatest(F.length(F.rtrim(sequence, F.lit("Nn"))), start))


def zero_cap(qualities: Column, base: int = 33) -> Column:
    """Qualities below the base become the base."""
    return F.translate(qualities, "".join(map(chr, range(1, base))), chr(base) * (base - 1))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


def edit_distance(first: Column, second: Column) -> Column:
    """As F.levenshtein, for many reads at once."""
    return letters.edit_distances()(first, second)


def length_tag(name: Column, tag: str, sequence: Column) -> Column:
    """`tag` and the number after it in a name become `tag` and the read's length."""
    return F.regexp_replace(name, F.lit(rf"\b{re.escape(tag)}[0-9]*\b"), F.concat(F.lit(re.sub(r"([\\$])", r"\\\1", tag)), F.length(sequence).cast("string")))


def strip_suffix(name: Column, suffix: str) -> Column:
    return F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def read_id(name: Column) -> Column:
    return F.regexp_extract(name, r"^(\S*)", 1)


def comment(name: Column) -> Column:
    return F.regexp_extract(name, r"^\S*\s+(.*)$", 1)


def last_adapter(matches: Column, none: str = "no_adapter") -> Column:
    return F.when(F.size(matches) > 0, F.try_element_at(matches, F.lit(-1))["adapter"]).otherwise(none)


class TemplateError(ValueError):
    """A template with unbalanced braces or unknown names."""


def template_parts(template: str, left: str = "{", right: str = "}") -> list[tuple[bool, str]]:
    """(whether it is a name in braces, text) of each part."""
    parts, at = [], 0
    for m in re.finditer(f"{re.escape(left)}([^{re.escape(left + right)}]*){re.escape(right)}", template):
        parts += [(False, template[at : m.start()]), (True, m[1])]
        at = m.end()
    parts.append((False, template[at:]))
    if any(left in text or right in text for named, text in parts if not named):
        raise TemplateError(f"braces don't match in {template!r}")
    return [(named, text) for named, text in parts if named or text]


def rename(template: str, columns: dict[str, Column]) -> Column:
    r"""A name made from a template such as `{id} {comment}`; \t stands for a tabulator."""
    out = []
    for named, text in template_parts(template.replace("\\t", "\t")):
        if named and text not in columns:
            raise TemplateError(f"unknown name {text!r}; known are {sorted(columns)}")
        out.append(F.coalesce(columns[text], F.lit("")) if named else F.lit(text))
    return F.concat(*out)


def rename_columns(name: Column, matches: Column | None = None, cut_prefix: Column | None = None, cut_suffix: Column | None = None, is_rc: Column | None = None) -> dict[str, Column]:
    empty = F.lit("")
    return {
        "header": name, "id": read_id(name), "comment": comment(name), "cut_prefix": empty if cut_prefix is None else cut_prefix, "cut_suffix": empty if cut_suffix is None else cut_suffix,
        "adapter_name": F.lit("no_adapter") if matches is None else last_adapter(matches), "rc": empty if is_rc is None else F.when(is_rc, "rc").otherwise(""),
    }


def add_affixes(name: Column, prefix: str = "", suffix: str = "", matches: Column | None = None) -> Column:
    """prefix + name + suffix; {name} in either stands for the last adapter."""
    adapter = F.lit("no_adapter") if matches is None else last_adapter(matches)
    fill = lambda text: F.replace(F.lit(text), F.lit("{name}"), adapter) if "{name}" in text else F.lit(text)
    return F.concat(fill(prefix), name, fill(suffix))


def n_count(sequence: Column) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, "Nn", ""))


def too_short(sequence: Column, n: int) -> Column:
    return F.length(sequence) < n


def too_long(sequence: Column, n: int) -> Column:
    return F.length(sequence) > n


def too_many_n(sequence: Column, cutoff: float) -> Column:
    """More N than the cutoff; below 1 it is a share of the length."""
    return n_count(sequence) > cutoff if cutoff >= 1 or cutoff == 0 else (F.length(sequence) > 0) & (n_count(sequence) / F.length(sequence) > cutoff)


def expected_errors(qualities: Column, base: int = 33) -> Column:
    """The sum of error probabilities; null without qualities or with characters below the base."""
    return letters.error_sums(base)(qualities)


def too_many_errors(qualities: Column, most: float, base: int = 33) -> Column:
    return F.coalesce(expected_errors(qualities, base) > most, F.lit(False))


def too_high_error_rate(qualities: Column, most: float, base: int = 33) -> Column:
    return F.coalesce((F.length(qualities) > 0) & (expected_errors(qualities, base) / F.length(qualities) > most), F.lit(False))


def casava_filtered(name: Column) -> Column:
    """Whether the comment says that the machine's own filter rejected the read."""
    return name.rlike(r"^[^ ]* .:Y:")


def fate(steps: list[tuple[str, Column]], none: str = "written") -> Column:
    """The first step whose predicate holds: a read that a filter takes isn't seen by later ones."""
    out = None
    for name, holds in steps:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return F.lit(none) if out is None else out.otherwise(none)


def pair_predicate(first: Column | None, second: Column | None, mode: str = "any") -> Column:
    """Whether a filter takes a pair: either read, both or the first; a predicate on one side only decides alone."""
    if first is None or second is None:
        return first if second is None else second
    return {"any": first | second, "both": first & second, "first": first}[mode]
