"""Reports of a run: everything is counted in one pass over the reads, added up over runs, and folded by Spark into JSON or text.

`counts` has a row for each different (fate, adapter, end, letters removed, errors, adjacent base), so its size follows the
adapters and the reads' lengths and not their number. Such tables may be stored and `merged`; all reports take them in place of a
run's result.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readmill.operators import stats
from readmill.plans.pipeline import Options
from readmill.plans.spec import Adapter, Linked, Single

#: Fates and what is said of them.
FATES = {
    "too_short": "too short", "too_long": "too long", "too_many_n": "with too many N", "too_many_expected_errors": "with too many expected errors", "too_high_average_error_rate": "with too high an average error rate",
    "casava_filtered": "rejected by the machine's filter", "discard_trimmed": "discarded with an adapter", "discard_untrimmed": "discarded without an adapter",
}
KEYS = ("kind", "side", "fate", "turned", "adapter", "end", "removed", "errors", "adjacent")
#: Bases before 3' adapters; empty for none and others.
BASES = ("A", "C", "G", "T", "")

def _sides(df: DataFrame) -> list[tuple[int, str, Column]]:
    """(number, suffix of its columns, sequence) of each side of a run's result."""
    return [(1, "1", F.col("r1.sequence")), (2, "2", F.col("r2.sequence"))] if "matches1" in df.columns else [(1, "", F.col("sequence"))]


def counts(df: DataFrame) -> DataFrame:
    """kind (read, match, poly_a), side, fate, turned, adapter, end, removed, errors, adjacent, n and, for kind read, sums of letters of each side."""
    sides = _sides(df)
    kinds = {"adapter": "string", "end": "string", "removed": "int", "errors": "int", "adjacent": "string"}

    def entry(kind: str, side: int, **known: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side"), *(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))

    parts = [F.array(entry("read", 0))]
    found = lambda k, suffix: F.transform(f"matches{suffix}", lambda m: entry("match", k, **stats.end_of(m, F.col(f"searched{suffix}"))))
    for k, suffix, _ in sides:
        gone = F.col(f"poly_a_trimmed{suffix}")
        parts.append(found(k, suffix))
        parts.append(F.when(gone > 0, F.array(entry("poly_a", k, removed=gone))).otherwise(F.array().cast(f"array<struct<kind:string,side:int,{','.join(f'{n}:{t}' for n, t in kinds.items())}>>")))
    each = {f"is_rc{s}": F.col(f"is_rc{s}") for _, s, _ in sides}
    turned = F.greatest(*(c.cast("int") for c in each.values())) if len(each) > 1 else next(iter(each.values())).cast("int")
    read = F.col("e.kind") == "read"
    values: dict[str, Column] = {}
    for k, suffix, sequence in sides:
        written = F.col("fate") == "written"
        values |= {
            f"bp_in{k}": F.length(f"original{suffix}"), f"bp_out{k}": F.length(sequence), f"bp_written{k}": F.when(written, F.length(sequence)).otherwise(0), f"quality_trimmed{k}": F.col(f"quality_trimmed{suffix}"),
            f"poly_a_trimmed{k}": F.col(f"poly_a_trimmed{suffix}"), f"with_adapter{k}": (F.size(f"matches{suffix}") > 0).cast("int"),
        }
    exploded = df.select("fate", turned.alias("turned"), *(v.alias(n) for n, v in values.items()), F.explode(F.concat(*parts)).alias("e"))
    keys = [F.col("e.kind").alias("kind"), F.col("e.side").alias("side"), "fate", "turned", *(F.col(f"e.{n}").alias(n) for n in kinds)]
    return exploded.groupBy(*keys).agg(F.count("*").alias("n"), *(stats.total(F.when(read, F.col(n))).alias(n) for n in values))


def merged(*tables: DataFrame) -> DataFrame:
    """The counts of several runs, files or batches as those of one: equal keys are added up, so any order and grouping gives the same."""
    both = reduce(DataFrame.unionByName, tables)
    return both.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in both.columns if c not in KEYS))


def folded(counted: DataFrame) -> DataFrame:
    """Counts folded to a row for each end of an adapter, each fate of the reads, and the poly-A tails of a side: `lengths` holds
    (removed, [(errors, n)]) in order, `bases` how often each base stood before. A row's size follows the lengths of the reads."""
    of_reads = F.col("kind") == "read"
    keys = ["kind", "side", "adapter", "end", "fate", "turned"]
    known = counted.withColumns({"on_rc": F.when(F.col("turned") == 1, F.col("n")).otherwise(0), **{c: F.when(of_reads, F.col(c)) for c in ("fate", "turned")}})
    sums = ["n", "on_rc", *(c for c in counted.columns if c not in (*KEYS, "n")), *(f"before_{b}" for b in BASES)]
    known = known.withColumns({f"before_{b}": F.when(F.col("adjacent") == b, F.col("n")).otherwise(0) for b in BASES})
    add = [F.sum(c).alias(c) for c in sums]
    by_errors = known.groupBy(*keys, "removed", "errors").agg(*add)
    by_length = by_errors.groupBy(*keys, "removed").agg(*add, F.sort_array(F.collect_list(F.struct("errors", F.col("n").alias("reads")))).alias("by_errors"))
    rows = by_length.groupBy(*keys).agg(*add, F.sort_array(F.collect_list(F.struct("removed", "by_errors"))).alias("lengths"))
    return rows.withColumn("bases", F.array(*(f"before_{b}" for b in BASES))).drop(*(f"before_{b}" for b in BASES))


def _plan(options: Options, paired: bool) -> list[tuple[int, Adapter]]:
    """(side, adapter) of all adapters."""
    sides = [(1, options.first), *([(2, options.second or options.first)] if paired and options.second else [])]
    return [(side, a) for side, how in sides for a in how.adapters]


def _end(row: dict[str, Any] | None, part: Single, reads: int, gc: float) -> dict[str, Any]:
    """What a report says of one end of an adapter; without a row, nothing was found there."""
    chance, lengths = stats.match_probabilities(part, gc), []
    for removed, by_errors in (row or {}).get("lengths") or ():
        c = Counter(dict(map(tuple, by_errors)))
        lengths.append({
            "len": removed, "count": sum(c.values()), "expect": reads * chance[min(removed, len(part.sequence))], "max_err": int(part.rate * min(removed, part.effective_length)), "counts": [c[e] for e in range(max(c) + 1)],
        })
    bases = dict(zip(BASES, (row or {}).get("bases") or (0,) * len(BASES)))
    n = sum(bases.values())
    often = next((b for b in "ACGT" if n >= 20 and bases[b] > 0.8 * n), None)
    return {"part": part, "matches": row["n"] if row else 0, "turned": row["on_rc"] if row else 0, "lengths": lengths, "bases": bases if n else None, "often": often}


def _both_ends(adapter: Adapter, found: dict[str, dict[str, Any]], reads: int, gc: float) -> dict[str, Any]:
    if isinstance(adapter, Linked):
        five, three = adapter.front, adapter.back
    else:
        five, three = (None if adapter.removes_before is False else adapter), (None if adapter.removes_before else adapter)
    ends = {e: _end(found.get(e), p, reads, gc) if p is not None else None for e, p in (("5p", five), ("3p", three))}
    return {"adapter": adapter, "ends": ends, **{what: sum(e[what] for e in ends.values() if e) for what in ("matches", "turned")}}


class Totals:
    """The counts of a run, or of several that `merged` has added up, as reports need them: a row for each end of an adapter."""

    def __init__(self, df: DataFrame, options: Options, gc: float = 0.5):
        counted = df if "kind" in df.columns else counts(df)
        self.options, self.gc = options, gc
        self.paired = "bp_in2" in counted.columns
        rows = [r.asDict(recursive=False) for r in folded(counted).collect()]
        self.of_reads = [r for r in rows if r["kind"] == "read"]
        self.found: dict[tuple[int, str], dict[str, dict[str, Any]]] = {}
        for r in rows:
            if r["kind"] != "read":
                self.found.setdefault((r["side"], r["adapter"]), {})[r["end"] or r["kind"]] = r
        self.reads = self.sum("n")
        self.fates = Counter()
        for r in self.of_reads:
            self.fates[r["fate"]] += r["n"]

    def sum(self, what: str, **where: Any) -> int:
        return sum(r.get(what, 0) for r in self.of_reads if all(r[k] == v for k, v in where.items()))

    def adapters(self, side: int) -> Sequence[Adapter]:
        return [a for k, a in _plan(self.options, self.paired) if k == side]

    def of_adapter(self, side: int, adapter: Adapter) -> dict[str, Any]:
        return _both_ends(adapter, self.found.get((side, adapter.name), {}), self.reads, self.gc)

    def poly_a(self, side: int) -> list[dict[str, int]]:
        row = self.found.get((side, None), {}).get("poly_a")
        return [{"len": n, "count": sum(c for _, c in by_errors)} for n, by_errors in row["lengths"]] if row else []


def _end_value(x: dict[str, Any] | None) -> dict[str, Any] | None:
    if x is None:
        return None
    p = x["part"]
    return {
        "type": p.identifier, "sequence": p.sequence, "error_rate": p.rate, "indels": p.indels, "error_lengths": [n for n, _ in stats.error_ranges(p)] if p.allows_partial_matches else None, "matches": x["matches"],
        "adjacent_bases": x["bases"], "dominant_adjacent_base": x["often"], "trimmed_lengths": [{"len": r["len"], "expect": round(r["expect"], 1), "counts": r["counts"]} for r in x["lengths"]],
    }


def _adapter_value(x: dict[str, Any], rc: bool) -> dict[str, Any]:
    a = x["adapter"]
    return {
        "name": a.name, "total_matches": x["matches"], "on_reverse_complement": x["turned"] if rc else None, "linked": isinstance(a, Linked), "five_prime_end": _end_value(x["ends"]["5p"]),
        "three_prime_end": _end_value(x["ends"]["3p"]),
    }


def sections(counted: DataFrame, options: Options, gc: float = 0.5) -> DataFrame:
    """side, number, adapter, section: the JSON of each adapter's part of the report, as in the whole report, made by Spark's tasks. Only
    the number of reads comes to the driver, so thousands of adapters and long reads don't. `counted` is read twice: give a stored table."""
    reads = counted.where("kind = 'read'").agg(stats.total(F.col("n")).alias("n")).first()["n"]
    plan, rc = _plan(options, "bp_in2" in counted.columns), options.first.rc
    schema = "number int, side int, adapter string"
    listed = counted.sparkSession.createDataFrame([(k, side, a.name) for k, (side, a) in enumerate(plan)], schema)
    rows = folded(counted.where("kind = 'match'")).select("side", "adapter", F.struct("end", "n", "on_rc", "lengths", "bases").alias("row"))
    found = rows.groupBy("side", "adapter").agg(F.collect_list("row").alias("ends"))  # two at most

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                ends = {e["end"]: e | {"lengths": [(x["removed"], [(y["errors"], y["reads"]) for y in x["by_errors"]]) for x in e["lengths"]]} for e in row["ends"] or ()}
                made.append(json.dumps(_adapter_value(_both_ends(plan[row["number"]][1], ends, reads, gc), rc)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("side", "number", "adapter")), pa.array(made, pa.string())], names=["side", "number", "adapter", "section"])

    return listed.join(found, ["side", "adapter"], "left").mapInArrow(values, "side int, number int, adapter string, section string")


def json_value(t: Totals) -> dict[str, Any]:
    rc, sides = t.options.first.rc, (1, 2) if t.paired else (1,)
    both = lambda what: sum(t.sum(f"{what}{k}") for k in sides)
    each = lambda what, name: {f"{name}_read{k}": t.sum(f"{what}{k}") if k in sides else None for k in (1, 2)}

    adapter = lambda side, a: _adapter_value(t.of_adapter(side, a), rc)
    poly = lambda k: t.poly_a(k) if k in sides and (t.options.first if k == 1 else t.options.second or t.options.first).poly_a else None
    return {
        "read_counts": {
            "input": t.reads, "filtered": {f: t.fates[f] for f in FATES}, "output": t.fates["written"], "reverse_complemented": t.sum("n", turned=1) if rc else None,
            "read1_with_adapter": t.sum("with_adapter1"), "read2_with_adapter": t.sum("with_adapter2") if t.paired else None,
        },
        "basepair_counts": {
            "input": both("bp_in"), **each("bp_in", "input"), "quality_trimmed": both("quality_trimmed"), **each("quality_trimmed", "quality_trimmed"), "poly_a_trimmed": both("poly_a_trimmed"),
            **each("poly_a_trimmed", "poly_a_trimmed"), "output": both("bp_written"), **each("bp_written", "output"),
        },
        "adapters_read1": [adapter(1, a) for a in t.adapters(1)], "adapters_read2": [adapter(2, a) for a in t.adapters(2)] if t.paired else None, "poly_a_trimmed_read1": poly(1), "poly_a_trimmed_read2": poly(2),
    }


def json_short(t: Totals) -> dict[str, Any]:
    """Read counts, letters, fates and the adapters' matches by length and errors, without the adapters' properties."""
    found: Counter = Counter()
    for (_, adapter), ends in t.found.items():
        if adapter is not None:
            for end, row in ends.items():
                found.update({(adapter, end, removed, errors): n for removed, by_errors in row["lengths"] for errors, n in by_errors})
    return {
        "read_counts": {"reads": t.reads, "with_adapter": t.sum("with_adapter1"), "written": t.fates["written"]}, "basepair_counts": {"bp_in": t.sum("bp_in1"), "bp_written": t.sum("bp_written1")},
        "filtered": {f: n for f, n in sorted(t.fates.items()) if f != "written"}, "adapters": [dict(zip(("adapter", "end", "removed", "errors", "reads"), (*k, n))) for k, n in sorted(found.items())],
    }


def json_report(df: DataFrame, options: Options | None = None, gc: float = 0.5) -> DataFrame:
    """One row, report: the JSON of a run's result; in full if the run's options are given."""
    t = Totals(df, options or Options(), gc)
    return df.sparkSession.createDataFrame([(json.dumps(json_short(t) if options is None else json_value(t)),)], "report string")


def _share(part: int, whole: int) -> str:
    return f"{part:>13,} ({100 * part / whole if whole else 0:.1f}%)"


def _histogram(x: dict[str, Any], title: str) -> list[str]:
    lines = [title, "length\tcount\texpect\tmax.err\terror counts"]
    return lines + [f"{r['len']}\t{r['count']}\t{r['expect']:.1f}\t{r['max_err']}\t{' '.join(map(str, r['counts']))}" for r in x["lengths"]] + [""]


def _allowed(part: Single) -> str:
    if not part.allows_partial_matches:
        return f"Allowed errors: {int(part.rate * part.effective_length)}"
    low, out = 1, []
    for n, e in stats.error_ranges(part):
        out.append(f"{low}-{n} bp: {e}" if n > low else f"{n} bp: {e}")
        low = n + 1
    return "Allowed errors: " + "; ".join(out)


def _adapter_lines(t: Totals, side: int, adapter: Adapter) -> list[str]:
    x = t.of_adapter(side, adapter)
    five, three = x["ends"]["5p"], x["ends"]["3p"]
    head = f"=== {('First read: ', 'Second read: ')[side - 1] if t.paired else ''}Adapter {adapter.name} ==="
    turned = f"; on the reverse complement: {x['turned']:,} times" if t.options.first.rc else ""
    if isinstance(adapter, Linked):
        about = f"Sequence: {adapter.front.sequence}...{adapter.back.sequence}; Type: linked; Length: {len(adapter.front.sequence)}+{len(adapter.back.sequence)}; 5' trimmed: {five['matches']:,} times; 3' trimmed: {three['matches']:,} times"
    else:
        about = f"Sequence: {adapter.sequence}; Type: {adapter.description}; Length: {len(adapter.sequence)}; Trimmed: {x['matches']:,} times"
    lines = [head, "", about + turned, ""]
    if not x["matches"]:
        return lines
    lines += [_allowed(e["part"]) for e in (five, three) if e is not None and (isinstance(adapter, Linked) or e is (five or three))] + [""]
    if three is not None and three["bases"]:
        n = sum(three["bases"].values())
        lines += ["Bases before removed adapters:", *(f"  {b or 'none/other'}: {100 * c / n:.1f}%" for b, c in three["bases"].items())]
        if three["often"]:
            lines += ["WARNING:", f"    {three['often']} stands before the adapter in nearly all reads: the adapter may lack a base at its 5' end.", "    This doesn't matter for primers."]
        lines.append("")
    both = five is not None and three is not None
    for e, name in ((five, "5'"), (three, "3'")):
        if e is not None and (e["matches"] or not both):
            lines += _histogram(e, f"Removed sequences at the {name} end" if both else "Removed sequences")
    return lines


def text_report(df: DataFrame, options: Options | None = None, gc: float = 0.5) -> str:
    """A summary to read, followed by a section for each adapter of the options."""
    t = Totals(df, options or Options(), gc)
    if not t.reads:
        return "No reads."
    what, sides = ("pairs", (1, 2)) if t.paired else ("reads", (1,))
    both = lambda name: sum(t.sum(f"{name}{k}") for k in sides)
    lines = ["=== Summary ===", "", f"{what.capitalize()}: {t.reads:,}"]
    for k in sides:
        lines.append(f"{'Reads' if not t.paired else f'Reads {k}'} with adapters: {_share(t.sum(f'with_adapter{k}'), t.reads).strip()}")
    if t.options.first.rc:
        lines.append(f"Turned to the reverse complement: {_share(t.sum('n', turned=1), t.reads).strip()}")
    lines += [f"{what.capitalize()} {text}: {_share(t.fates[f], t.reads).strip()}" for f, text in FATES.items() if t.fates[f]]
    lines += [f"{what.capitalize()} written: {_share(t.fates['written'], t.reads).strip()}", "", f"Base pairs: {both('bp_in'):,}"]
    for name, text in (("quality_trimmed", "trimmed by quality"), ("poly_a_trimmed", "trimmed as poly-A"), ("bp_written", "written")):
        if both(name) or name == "bp_written":
            lines.append(f"Base pairs {text}: {_share(both(name), both('bp_in')).strip()}")
            lines += [f"  Read {k}: {t.sum(f'{name}{k}'):,}" for k in sides if t.paired]
    for k in sides:
        for a in t.adapters(k):
            lines += ["", *_adapter_lines(t, k, a)]
        if t.poly_a(k):
            lines += ["", f"=== Poly-A{f' of read {k}' if t.paired else ''} ===", "", "length\tcount", *(f"{r['len']}\t{r['count']}" for r in t.poly_a(k))]
    return "\n".join(lines)


def minimal_report(df: DataFrame, options: Options | None = None) -> str:
    """One header line and one line of values, separated by tabulators."""
    t = Totals(df, options or Options())
    names = ["too_short", "too_long", "too_many_n"]
    head = ["status", "in_reads", "in_bp", *names, "out_reads", "w/adapters", "out_bp"]
    values: list[Any] = ["OK", t.reads, t.sum("bp_in1") + t.sum("bp_in2"), *(t.fates[n] for n in names), t.fates["written"], t.sum("with_adapter1"), t.sum("bp_written1") + t.sum("bp_written2")]
    if t.paired:
        head += ["w/adapters2"]
        values += [t.sum("with_adapter2")]
    return "\n".join("\t".join(map(str, x)) for x in (head, values))
