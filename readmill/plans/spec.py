"""The adapter language: text such as `name=^ACG{3}T;e=0.2` or `FRONT...BACK;optional` becomes Adapter plans on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from readmill.sources.parts import FormatError, fasta_records, open_any

FRONT, BACK, ANYWHERE = "front", "back", "anywhere"
#: Where an alignment may leave parts of adapter or read unaligned at no cost.
START_ADAPTER, START_READ, STOP_ADAPTER, STOP_READ = 1, 2, 4, 8
#: kind: (free ends, removes what is before the match, runs on reversed strings)
KINDS = {
    "front": (START_ADAPTER | START_READ | STOP_READ, True, False),
    "back": (START_READ | STOP_ADAPTER | STOP_READ, False, False),
    "anywhere": (START_ADAPTER | START_READ | STOP_ADAPTER | STOP_READ, None, False),
    "prefix": (STOP_READ, True, False),
    "suffix": (START_READ, False, False),
    "noninternal_front": (START_ADAPTER | STOP_READ, True, False),
    "noninternal_back": (START_READ | STOP_ADAPTER, False, False),
    "rightmost_front": (START_READ | STOP_ADAPTER | STOP_READ, True, True),
    "rightmost_back": (START_ADAPTER | START_READ | STOP_READ, False, True),
}
#: What reports call the kinds.
IDENTIFIERS = {
    "front": "regular_five_prime", "back": "regular_three_prime", "anywhere": "anywhere", "prefix": "anchored_five_prime", "suffix": "anchored_three_prime", "noninternal_front": "noninternal_five_prime",
    "noninternal_back": "noninternal_three_prime", "rightmost_front": "rightmost_five_prime", "rightmost_back": "rightmost_three_prime",
}
#: Names of search parameters and what they set.
ALIASES = {
    "e": "max_errors", "error_rate": "max_errors", "max_error_rate": "max_errors", "max_errors": "max_errors", "o": "min_overlap", "min_overlap": "min_overlap",
    "anywhere": "anywhere", "required": "required", "optional": "optional", "indels": "indels", "noindels": "noindels", "rightmost": "rightmost",
}
MOST_REPEATS = 10_000


class SpecError(ValueError):
    """An adapter specification that isn't valid."""


@dataclass(frozen=True)
class Search:
    """Defaults for adapters that don't set their own."""

    max_errors: float = 0.1
    min_overlap: int = 3
    indels: bool = True
    adapter_wildcards: bool = True
    read_wildcards: bool = False
    prefilter: bool = True


@dataclass(frozen=True)
class Single:
    """One adapter, ready to be searched for."""

    name: str
    kind: str
    sequence: str
    rate: float
    min_overlap: int
    indels: bool
    adapter_wildcards: bool
    read_wildcards: bool
    force_anywhere: bool = False
    prefilter: bool = True

    @property
    def free_ends(self) -> int:
        return 15 if self.force_anywhere else KINDS[self.kind][0]

    @property
    def removes_before(self) -> bool | None:
        return KINDS[self.kind][1]

    @property
    def reverse(self) -> bool:
        return KINDS[self.kind][2]

    @property
    def anchored(self) -> bool:
        return self.kind in ("prefix", "suffix")

    @property
    def allows_partial_matches(self) -> bool:
        return not self.anchored

    @property
    def effective_length(self) -> int:
        return len(self.sequence) - (self.sequence.count("N") if self.adapter_wildcards else 0)

    @property
    def spec(self) -> str:
        s = self.sequence
        return {"prefix": f"^{s}...", "suffix": f"{s}$", "noninternal_front": f"X{s}...", "noninternal_back": f"{s}X", "front": f"{s}...", "anywhere": f"...{s}...", "rightmost_front": f"{s}...;rightmost", "rightmost_back": f"{s};rightmost"}.get(self.kind, s)

    @property
    def description(self) -> str:
        return {
            "front": "regular 5'", "back": "regular 3'", "anywhere": "variable 5'/3'", "prefix": "anchored 5'", "suffix": "anchored 3'", "noninternal_front": "non-internal 5'",
            "noninternal_back": "non-internal 3'", "rightmost_front": "rightmost 5'", "rightmost_back": "rightmost 3'",
        }[self.kind]

    @property
    def identifier(self) -> str:
        return IDENTIFIERS[self.kind]


@dataclass(frozen=True)
class Linked:
    """A 5' adapter and a 3' adapter that is searched for in what the first leaves."""

    name: str
    front: Single
    back: Single
    front_required: bool
    back_required: bool
    kind: str = field(default="linked", init=False)

    @property
    def spec(self) -> str:
        return f"{self.front.spec}{self.back.spec}"

    @property
    def description(self) -> str:
        return "linked"


Adapter = Single | Linked


def expand_repeats(sequence: str) -> str:
    """`A{5}` stands for AAAAA."""
    if re.search(r"^\{|\{[^}]*(\{|$)|(^|\})[^{]*\}", sequence):
        raise SpecError(f"braces don't match in {sequence!r}")

    def again(m: re.Match) -> str:
        if not m[2].isdigit() or int(m[2]) > MOST_REPEATS:
            raise SpecError(f"a number of repeats up to {MOST_REPEATS} is needed in braces, not {m[2]!r}")
        return m[1] * int(m[2])

    return re.sub(r"(.)\{([^}]*)\}", again, sequence)


def parameters_of(text: str) -> dict[str, bool | int | float]:
    """`e=0.2;noindels` as a dictionary of full names."""
    found: dict[str, bool | int | float] = {}
    for item in filter(None, (x.strip() for x in text.split(";"))):
        name, eq, value = (x.strip() for x in item.partition("="))
        if name not in ALIASES:
            raise SpecError(f"unknown parameter {name!r}")
        if eq and not value:
            raise SpecError(f"no value given for {name!r}")
        try:
            got: bool | int | float = True if not eq else int(value) if re.fullmatch(r"[+-]?\d+", value) else float(value)
        except ValueError as e:
            raise SpecError(f"{value!r} isn't a number") from e
        if ALIASES[name] in found:
            raise SpecError(f"parameter {name!r} given twice")
        found[ALIASES[name]] = got
    for a, b in (("optional", "required"), ("indels", "noindels")):
        if a in found and b in found:
            raise SpecError(f"{a!r} and {b!r} can't both be given")
    if found.pop("optional", False):
        found["required"] = False
    if found.pop("noindels", False):
        found["indels"] = False
    return {k: bool(v) if k in ("required", "indels", "anywhere", "rightmost") else v for k, v in found.items()}


def split_spec(text: str) -> tuple[str | None, str, dict]:
    """name, sequence, parameters."""
    head, _, tail = text.partition(";")
    name, eq, sequence = head.partition("=")
    return (name.strip() or None, sequence.strip(), parameters_of(tail)) if eq else (None, head.strip(), parameters_of(tail))


def restriction_of(sequence: str) -> tuple[str, str, str]:
    """The sequence without its marks, and the marks before and behind: '', anchored or noninternal."""
    before = "anchored" if sequence.startswith("^") else "noninternal" if sequence[:1] in ("X", "x") else ""
    behind = "anchored" if sequence.endswith("$") else "noninternal" if sequence[-1:] in ("X", "x") else ""
    core = sequence[1:] if before == "anchored" else sequence.lstrip("Xx") if before else sequence
    core = core[:-1] if behind == "anchored" else core.rstrip("Xx") if behind else core
    if before and behind:
        raise SpecError(f"only one placement restriction can be given: {sequence!r}")
    if re.search(r"[\^$]", core):
        raise SpecError(f"^ and $ stand at the ends only: {sequence!r}")
    return core, before, behind


def single(text: str, side: str, search: Search, name: str = "") -> tuple[Single, dict]:
    """The plan for one adapter, and its parameters."""
    own, sequence, parameters = split_spec(text)
    sequence = expand_repeats(sequence)
    rightmost = parameters.pop("rightmost", False)
    before = behind = ""
    if sequence and not set(sequence) <= {"X", "x"}:
        sequence, before, behind = restriction_of(sequence)
    if side == FRONT and behind or side == BACK and before:
        raise SpecError(f"{text!r}: this restriction isn't for a {side} adapter")
    restriction = before or behind
    if side == ANYWHERE and restriction:
        raise SpecError(f"{text!r}: restrictions aren't for adapters that may be anywhere")
    if rightmost and (restriction or side == ANYWHERE):
        raise SpecError(f"{text!r}: 'rightmost' is for regular 5' and 3' adapters only")
    if "min_overlap" in parameters and restriction == "anchored":
        raise SpecError(f"{text!r}: an anchored adapter always matches in full")
    if not sequence:
        raise SpecError(f"{text!r}: the adapter is empty")
    kind = {("front", "anchored"): "prefix", ("back", "anchored"): "suffix", ("front", "noninternal"): "noninternal_front", ("back", "noninternal"): "noninternal_back"}.get((side, restriction), f"rightmost_{side}" if rightmost else side)
    if parameters.get("anywhere") and kind not in ("front", "back", "rightmost_front", "rightmost_back"):
        raise SpecError(f"{text!r}: 'anywhere' is for regular 5' and 3' adapters only")
    sequence = sequence.upper().replace("U", "T").replace("I", "N")
    wildcards = search.adapter_wildcards and not set(sequence) <= set("ACGT")
    named = sum(c != "N" for c in sequence) if wildcards else len(sequence)
    if wildcards and not named:
        raise SpecError(f"{text!r}: the adapter has wildcards only")
    errors = float(parameters.get("max_errors", search.max_errors))
    rate = errors / max(1, sum(c != "N" for c in sequence)) if errors >= 1 else errors
    overlap = len(sequence) if kind in ("prefix", "suffix") else min(int(parameters.get("min_overlap", search.min_overlap)), len(sequence))
    plan = Single(own or name, kind, sequence, rate, overlap, bool(parameters.get("indels", search.indels)), wildcards, search.read_wildcards, bool(parameters.get("anywhere", False)), search.prefilter)
    return plan, parameters


def adapter(text: str, side: str, search: Search | None = None, name: str = "1") -> Adapter:
    """The plan for one specification. FRONT...BACK is a linked adapter; ADAPTER... is a front and ...ADAPTER a back adapter."""
    search = search or Search()
    first, dots, second = text.partition("...")
    if not dots:
        return single(text, side, search, name)[0]
    if side == ANYWHERE:
        raise SpecError(f"{text!r}: adapters that may be anywhere can't be linked")
    if first and second:
        return linked(first, second, side, search, name)
    if not first and side == FRONT:
        raise SpecError(f"{text!r}: the 5' adapter is missing")
    return single(first or second, FRONT if first else BACK, search, name)[0]


def linked(first: str, second: str, side: str, search: Search, name: str) -> Linked:
    front, of_front = single(first, FRONT, search, name)
    back, of_back = single(second, BACK, search, name)
    both = side == FRONT  # given as a front adapter, both parts must be there; else those that are restricted
    need = lambda plan, own: own.get("required", both or plan.kind != ("front" if plan is front else "back"))
    return Linked(front.name, front, replace(back, name=front.name), need(front, of_front), need(back, of_back))


def adapters(specs: list[tuple[str, str]], search: Search | None = None) -> list[Adapter]:
    """Plans of (side, text) pairs; those without a name are numbered from 1. `file:path` stands for the records of a FASTA file."""
    found: list[tuple[str, str, str]] = []
    for side, text in specs:
        m = re.match(r"(\^?)file(\$?):([^;]*)(;.*)?$", text)
        if not m:
            found.append((side, "", text))
            continue
        for name, sequence in fasta(m[3]):
            found.append((side, name, f"{m[1]}{sequence}{m[2]}{m[4] or ''}"))
    return [adapter(text, side, search, name or str(k)) for k, (side, name, text) in enumerate(found, 1)]


def fasta(path: str) -> list[tuple[str, str]]:
    """Names (first words) and sequences of the records of a small FASTA file, which may be compressed."""
    try:
        with open_any(path) as stream:
            return [((name.split() or [""])[0], sequence) for _, name, sequence, _ in fasta_records(stream, path)]
    except FormatError as e:
        raise SpecError(str(e)) from e


def allowed_errors(length: int, rate: float) -> int:
    return math.floor(length * rate)
