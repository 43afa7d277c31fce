"""Records about matches: info, rest and wildcard files as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readmill.functions.reads import cut, interval
from readmill.plans.spec import Adapter, Linked, Single


def info_records(df: DataFrame, sequence: str = "sequence", qualities: str = "qualities", matches: str = "matches", is_rc: str | None = None) -> DataFrame:
    """A row for each match: name, errors, rstart, rstop, the read before, in and after the match, adapter, the same three parts of
    the qualities. Reads without a match have one row with errors -1 and the whole read in `before`. df holds untrimmed reads."""
    m = F.col("m")
    seen = interval(m["from"], m["to"])
    part = lambda c, a, b: F.substring(cut(F.col(c), seen), a + 1, F.greatest(b - a, F.lit(0)))
    end = m["to"] - m["from"]
    rows = df.select("name", sequence, qualities, *([is_rc] if is_rc else []), F.posexplode_outer(matches).alias("k", "m"))
    none = m.isNull()
    pieces = lambda c: [F.when(none, F.col(c)).otherwise(part(c, F.lit(0), m["rstart"])), F.when(~none, part(c, m["rstart"], m["rstop"])), F.when(~none, part(c, m["rstop"], end))]
    s, q = pieces(sequence), pieces(qualities)
    adapter = F.when(m["part"] > 0, F.concat(m["adapter"], F.lit(";"), m["part"].cast("string"))).otherwise(m["adapter"])
    columns = [F.col("name"), F.coalesce(m["errors"], F.lit(-1)).alias("errors"), m["rstart"].alias("rstart"), m["rstop"].alias("rstop"), s[0].alias("seq_before"), s[1].alias("seq_match"), s[2].alias("seq_after"), adapter.alias("adapter"), q[0].alias("qual_before"), q[1].alias("qual_match"), q[2].alias("qual_after")]
    return rows.select(*columns, *([F.col(is_rc).cast("int").alias("rc")] if is_rc else []), F.coalesce("k", F.lit(0)).alias("match_no"))


def info_lines(records: DataFrame) -> DataFrame:
    """The records as the lines of an info file."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    columns = ["name", "errors", "rstart", "rstop", "seq_before", "seq_match", "seq_after", "adapter", "qual_before", "qual_match", "qual_after"]
    hit = F.concat_ws("\t", *map(cell, columns + (["rc"] if "rc" in records.columns else [])))
    return records.select(F.when(F.col("errors") < 0, F.concat_ws("\t", *map(cell, ["name", "errors", "seq_before", "qual_before"]))).otherwise(hit).alias("value"))


def rest_records(df: DataFrame, sequence: str = "sequence", matches: str = "matches") -> DataFrame:
    """rest, name: what lies beyond the last match, of reads that have one and something there."""
    m = F.try_element_at(F.col(matches), F.lit(-1))
    seen = cut(F.col(sequence), interval(m["from"], m["to"]))
    rest = F.when(m["side"] == "before", F.substring(seen, F.lit(1), m["rstart"])).otherwise(F.substring(seen, m["rstop"] + 1, F.length(seen)))
    return df.where(F.size(matches) > 0).select(rest.alias("rest"), "name").where("rest <> ''")


def wildcard_records(df: DataFrame, adapters: Sequence[Adapter], sequence: str = "sequence", matches: str = "matches") -> DataFrame:
    """bases, name: the read's letters under the adapter's N in the last match."""
    m = F.try_element_at(F.col(matches), F.lit(-1))
    parts: list[Single] = [p for a in adapters for p in ((a.front, a.back) if isinstance(a, Linked) else (a,))]
    text = F.lit("")
    for p in parts:
        text = F.when(m["adapter"] == p.name, F.lit(p.sequence)).otherwise(text)
    seen = cut(F.col(sequence), interval(m["from"], m["to"]))
    places = F.filter(F.sequence(F.lit(0), F.greatest(m["astop"] - m["astart"] - 1, F.lit(0))), lambda i: (F.substring(text, m["astart"] + i + 1, F.lit(1)) == "N") & (m["rstart"] + i < F.length(seen)))
    bases = F.array_join(F.transform(places, lambda i: F.substring(seen, m["rstart"] + i + 1, F.lit(1))), "")
    return df.where(F.size(matches) > 0).select(bases.alias("bases"), "name")
