"""Rows that follow from the adapter language alone (specifications, pieces, neighbourhoods, templates), against DuckDB or the rows themselves."""

from collections.abc import Callable

import duckdb
import pytest

from readmill.functions import reads as R
from readmill.operators import stats
from readmill.operators import trim as T
from readmill.plans.spec import ANYWHERE, BACK, FRONT, SpecError, adapter, adapters
from readmill.queries import A3

KNOWN: dict[str, tuple[Callable[[], list[tuple]], str, str]] = {}


def _values(columns: str, rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    text = ", ".join(f"({', '.join(map(cell, r))})" for r in rows).replace("True", "true").replace("False", "false")
    return f"SELECT * FROM (VALUES {text.replace(chr(39) * 3, chr(39))}) AS v({columns})"


def _table(key: str, schema: str, rows: Callable[[], list[tuple]], sql: str) -> None:
    KNOWN[key] = rows, schema, sql


_SPECS = [
    (BACK, "x=ACG{3}T;e=0.2;o=4"), (FRONT, "^ACGTACGTAC"), (BACK, "ACGTACGTAC$;noindels"), (FRONT, "XACGTAC"), (BACK, "ACGTACX;e=1"), (ANYWHERE, "ACGTNNAC"), (FRONT, "UUIIACGT;rightmost"), (BACK, "GGGG;rightmost;o=2"),
    (BACK, "ACGTA..."), (BACK, "...ACGTA"), (BACK, "q=^AAAACCCC...GGGGTTTT"), (FRONT, "AAAACCCC...GGGGTTTT;optional"), (BACK, "AAAAC...GGGGT$"),
]


def _spec_rows() -> list[tuple]:
    out = []
    for a in adapters(_SPECS):
        for part, k in ((a.front, 1), (a.back, 2)) if a.kind == "linked" else ((a, 0),):
            required = (a.front_required if k == 1 else a.back_required) if k else None
            out.append((a.name, k, part.kind, part.sequence, round(part.rate, 6), part.min_overlap, part.indels, part.effective_length, part.allows_partial_matches, required))
    return out


_table(
    "adapter_specs", "name string, part int, kind string, sequence string, rate double, min_overlap int, indels boolean, effective int, partial boolean, required boolean", _spec_rows,
    "SELECT name, part, kind, sequence, CAST(rate AS DOUBLE) AS rate, min_overlap, indels, effective, partial, CAST(required AS BOOLEAN) AS required FROM (" + _values("name, part, kind, sequence, rate, min_overlap, indels, effective, partial, required", [
        ("x", 0, "back", "ACGGGT", 0.2, 4, True, 6, True, None), ("2", 0, "prefix", "ACGTACGTAC", 0.1, 10, True, 10, False, None), ("3", 0, "suffix", "ACGTACGTAC", 0.1, 10, False, 10, False, None),
        ("4", 0, "noninternal_front", "ACGTAC", 0.1, 3, True, 6, True, None), ("5", 0, "noninternal_back", "ACGTAC", 0.166667, 3, True, 6, True, None), ("6", 0, "anywhere", "ACGTNNAC", 0.1, 3, True, 6, True, None),
        ("7", 0, "rightmost_front", "TTNNACGT", 0.1, 3, True, 6, True, None), ("8", 0, "rightmost_back", "GGGG", 0.1, 2, True, 4, True, None), ("9", 0, "front", "ACGTA", 0.1, 3, True, 5, True, None), ("10", 0, "back", "ACGTA", 0.1, 3, True, 5, True, None),
        ("q", 1, "prefix", "AAAACCCC", 0.1, 8, True, 8, False, True), ("q", 2, "back", "GGGGTTTT", 0.1, 3, True, 8, True, False), ("12", 1, "front", "AAAACCCC", 0.1, 3, True, 8, True, True), ("12", 2, "back", "GGGGTTTT", 0.1, 3, True, 8, True, False),
        ("13", 1, "front", "AAAAC", 0.1, 3, True, 5, True, False), ("13", 2, "suffix", "GGGGT", 0.1, 5, True, 5, False, True),
    ]) + ")",
)

_BAD = ["ACGT;e=2;x=1", "ACGT;o=1;min_overlap=2", "A{2", "A{}", "^ACGT$", "ACGT;optional;required", "ACGT;e=", "^ACGT;o=3", "", "ACGT"]


def _bad_rows() -> list[tuple]:
    def fails(spec: str) -> bool:
        try:
            adapters([(BACK, spec)])
        except SpecError:
            return True
        return False

    return [(spec, fails(spec)) for spec in _BAD]


_table("adapter_spec_errors", "spec string, fails boolean", _bad_rows, _values("spec, fails", [(spec, spec != "ACGT") for spec in _BAD]))

_FOUR = "(VALUES ('A'), ('C'), ('G'), ('T'))"
_LENGTHS = {n: "SELECT " + " || ".join(f"l{k}.c" for k in range(n)) + " AS s FROM " + ", ".join(f"{_FOUR} AS l{k}(c)" for k in range(n)) for n in range(3, 8)}
_table("hamming_sphere", "s string, errors int", lambda: list(T.neighbours("GATTA", 2).items()), f"SELECT s, CAST(hamming(s, 'GATTA') AS INT) AS errors FROM ({_LENGTHS[5]}) WHERE hamming(s, 'GATTA') <= 2")
_table("edit_environment", "s string, errors int", lambda: list(T.edit_neighbours("GATTA", 2).items()), f"SELECT s, CAST(levenshtein(s, 'GATTA') AS INT) AS errors FROM ({' UNION ALL '.join(_LENGTHS.values())}) WHERE levenshtein(s, 'GATTA') <= 2")
_table("template_parts", "place int, named boolean, part string", lambda: [(k, *p) for k, p in enumerate(R.template_parts("{id}_x {comment}-{rc}!"))], _values("place, named, part", [(0, True, "id"), (1, False, "_x "), (2, True, "comment"), (3, False, "-"), (4, True, "rc"), (5, False, "!")]))
_table(
    "error_ranges", "sequence string, up_to int, errors int", lambda: [(a.sequence, n, e) for a in adapters([(BACK, A3), (BACK, "ACGTNNACGTACGTACGTACGT;e=0.2")]) for n, e in stats.error_ranges(a)],
    f"SELECT s AS sequence, CAST(max(n) AS INT) AS up_to, CAST(floor(n * tenths / 10.0) AS INT) AS errors FROM (VALUES ('{A3}', 13, 1), ('ACGTNNACGTACGTACGTACGT', 20, 2)) AS a(s, size, tenths), range(1, 21) AS t(n) WHERE n <= size GROUP BY s, floor(n * tenths / 10.0)",
)


def _windows_rows() -> list[tuple]:
    from readmill.plans.windows import windows

    return [(spec, a, b, p) for spec, side in (("TTAGACATATCTCCGTCG", BACK), ("AGATCGGAAGAGC", FRONT)) for (a, b), pieces in windows(adapter(spec, side)).items() for p in pieces]


_table("kmer_windows", "adapter string, start int, stop int, piece string", _windows_rows, _values("adapter, start, stop, piece", [
    ("TTAGACATATCTCCGTCG", -3, None, "TTA"), ("TTAGACATATCTCCGTCG", -4, None, "TTAG"), ("TTAGACATATCTCCGTCG", -18, None, "TTAGA"), ("TTAGACATATCTCCGTCG", -18, None, "CATAT"), ("TTAGACATATCTCCGTCG", 0, None, "TTAGACATA"), ("TTAGACATATCTCCGTCG", 0, None, "TCTCCGTCG"),
    ("AGATCGGAAGAGC", 0, 3, "AGC"), ("AGATCGGAAGAGC", 0, 4, "GAGC"), ("AGATCGGAAGAGC", 0, 13, "AGAGC"), ("AGATCGGAAGAGC", 0, 13, "TCGGA"), ("AGATCGGAAGAGC", 0, None, "AGATCGG"), ("AGATCGGAAGAGC", 0, None, "AAGAGC"),
]))


@pytest.mark.parametrize("key", list(KNOWN))
def test_known_rows(key):
    rows, schema, sql = KNOWN[key]
    names = [c.split()[0] for c in schema.split(", ")]
    found = duckdb.connect().sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(map(repr, rows())) == sorted(map(repr, found))
