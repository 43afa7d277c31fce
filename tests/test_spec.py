"""The adapter language and its errors."""

import pytest

from readmill.functions.reads import TemplateError, template_parts
from readmill.operators.stats import error_ranges, match_probabilities
from readmill.operators.trim import edit_neighbours, neighbours
from readmill.plans.spec import ANYWHERE, BACK, FRONT, Linked, Search, SpecError, adapter, adapters


@pytest.mark.parametrize(
    "side, text, kind, sequence",
    [
        (BACK, "ACGT", "back", "ACGT"), (FRONT, "ACGT", "front", "ACGT"), (ANYWHERE, "acgu", "anywhere", "ACGT"), (FRONT, "^ACGT", "prefix", "ACGT"), (BACK, "ACGT$", "suffix", "ACGT"), (FRONT, "XXACGT", "noninternal_front", "ACGT"),
        (BACK, "ACGTX", "noninternal_back", "ACGT"), (FRONT, "ACGT;rightmost", "rightmost_front", "ACGT"), (BACK, "ACGT;rightmost", "rightmost_back", "ACGT"), (BACK, "AC{3}GT", "back", "ACCCGT"), (BACK, "ACGT...", "front", "ACGT"),
        (BACK, "...ACGT", "back", "ACGT"), (FRONT, "^ACGT...", "prefix", "ACGT"), (BACK, "ACGIT", "back", "ACGNT"),
    ],
)
def test_kinds(side, text, kind, sequence):
    a = adapter(text, side)
    assert (a.kind, a.sequence) == (kind, sequence)


def test_parameters():
    a = adapter("name=ACGTACGTAC;e=2;o=20;noindels", BACK)
    assert (a.name, a.rate, a.min_overlap, a.indels) == ("name", 0.2, 10, False)
    assert adapter("ACGT;e=0.25;anywhere", FRONT).free_ends == 15
    assert adapter("ACGT;indels=0", BACK).indels is False
    assert not adapter("ACGT", BACK).adapter_wildcards and adapter("ACNT", BACK).adapter_wildcards


@pytest.mark.parametrize(
    "side, text",
    [
        (FRONT, "ACGT$"), (BACK, "^ACGT"), (ANYWHERE, "^ACGT"), (FRONT, "^ACGT;o=3"), (BACK, "ACGT;x=1"), (BACK, "ACGT;e=1;e=2"), (BACK, "ACGT;e="), (BACK, "ACGT;required;optional"), (BACK, "A{"), (BACK, "A{x}"), (BACK, "A{10001}"), (BACK, "{3}"),
        (BACK, ""), (FRONT, "...ACGT"), (ANYWHERE, "ACGT...ACGT"), (FRONT, "^ACGT;rightmost"), (BACK, "NNN"), (BACK, "ACGT;indels;noindels"), (BACK, "X^ACGT"),
    ],
)
def test_errors(side, text):
    with pytest.raises(SpecError):
        adapter(text, side)


def test_linked():
    a, b, c = adapter("n=^AAA...TTT", BACK), adapter("AAA...TTT", FRONT), adapter("AAA;required...TTT;optional", FRONT)
    assert isinstance(a, Linked) and (a.name, a.front_required, a.back_required) == ("n", True, False)
    assert (b.front_required, b.back_required) == (True, True) and (c.front_required, c.back_required) == (True, False)


def test_files_and_names(tmp_path):
    (tmp_path / "a.fa").write_text("# comment\n>one more\nAC\nGT\n>two\nTTTT\n")
    found = adapters([(FRONT, f"^file:{tmp_path}/a.fa;e=0"), (BACK, "GGGG")], Search())
    assert [(a.name, a.kind, a.sequence) for a in found] == [("one", "prefix", "ACGT"), ("two", "prefix", "TTTT"), ("3", "back", "GGGG")]


def test_templates():
    assert template_parts("{id}_{x} y") == [(True, "id"), (False, "_"), (True, "x"), (False, " y")]
    for bad in ("{id", "id}", "{a{b}}"):
        with pytest.raises(TemplateError):
            template_parts(bad)


def test_neighbourhoods():
    assert len(neighbours("ACGTA", 2)) == 1 + 5 * 3 + 10 * 9
    near = edit_neighbours("ACGT", 1)
    assert near["ACGT"] == 0 and near["AGT"] == near["ACGGT"] == near["TCGT"] == 1 and "GG" not in near


def test_statistics_of_adapters():
    assert match_probabilities(adapter("ACGN", BACK)) == [1.0, 0.25, 0.0625, 0.015625, 0.015625]
    assert error_ranges(adapter("ACGTACGTAC;e=0.2", BACK)) == [(4, 0), (9, 1), (10, 2)]
