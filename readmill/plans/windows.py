"""Where a piece of an adapter must occur exactly if the adapter is to match: windows of a read, each with a set of pieces.

With at most e errors, one of e + 1 chunks of an adapter is intact. Inside a read a chunk may stand anywhere; an overlap at a
read's end lies within as many letters as that overlap is long. The windows decide which reads are aligned at all, so they
are part of the search's meaning and not only a short cut.
"""

from __future__ import annotations

import re
from collections import defaultdict

from readmill.operators.alphabet import matching_letters
from readmill.plans.spec import Single

#: Letters for which pieces can be searched; any other in the adapter turns the windows off.
SEARCHABLE = set("ABCDGHKMNRSTUVWXY")
#: Overlaps shorter than this are searched as wholes.
SHORT = 5
Window = tuple[int, int | None]


def chunks(sequence: str, n: int) -> set[str]:
    """The sequence in n parts of nearly equal length, longer ones first."""
    length, longer = divmod(len(sequence), n)
    ends = [k * length + min(k, longer) for k in range(n + 1)]
    return {sequence[a:b] for a, b in zip(ends, ends[1:])}


def end_windows(sequence: str, min_overlap: int, rate: float) -> list[tuple[int, set[str]]]:
    """For overlaps of the adapter's start with a read's end: letters from the end, and the pieces to be found there.

    Overlaps with the same number of errors allowed share one window, as wide as the longest of them; its pieces are those of
    the shortest, one more than errors. Short overlaps without errors are looked for as they are."""
    found, lengths = [], defaultdict(list)
    for n in range(min_overlap, len(sequence) + 1):
        lengths[int(n * rate)].append(n)
    for errors, of in sorted(lengths.items()):
        shortest, longest = of[0], of[-1]
        if not errors:
            found += [(n, {sequence[:n]}) for n in of if n < SHORT]
            shortest = max(shortest, min(SHORT, len(sequence)))
        if shortest <= longest:
            found.append((longest, chunks(sequence[:shortest], errors + 1)))
    return found


def windows(adapter: Single) -> dict[Window, set[str]] | None:
    """{(start, stop): pieces}, positions as in Python slices; None if every read is to be aligned. An adapter that may lie anywhere overlaps
    with both ends of a read, whatever its kind."""
    sequence = adapter.sequence[::-1] if adapter.reverse else adapter.sequence
    kind = {"rightmost_front": "back", "rightmost_back": "front"}.get(adapter.kind, adapter.kind)
    if not adapter.prefilter or not set(sequence) <= SEARCHABLE or adapter.anchored and not adapter.indels:
        return None
    places: dict[str, set[Window]] = defaultdict(set)
    if adapter.force_anywhere or kind in ("back", "anywhere", "suffix", "noninternal_back"):
        for n, pieces in end_windows(sequence, adapter.min_overlap, adapter.rate):
            for p in pieces:
                places[p].add((-n, None))
    if adapter.force_anywhere or kind in ("front", "anywhere", "prefix", "noninternal_front"):
        for n, pieces in end_windows(sequence[::-1], adapter.min_overlap, adapter.rate):
            for p in pieces:
                places[p[::-1]].add((0, n))
    if kind in ("front", "back", "anywhere"):
        for p in chunks(sequence, int(len(sequence) * adapter.rate) + 1):
            places[p].add((0, None))
    found: dict[Window, set[str]] = defaultdict(set)
    for piece, at in places.items():
        if (0, None) in at:
            at = {(0, None)}
        else:  # the widest window at either end holds the others
            at = {(min(s for s, _ in ends), None) for ends in [[w for w in at if w[1] is None]] if ends} | {(0, max(e for _, e in ends)) for ends in [[w for w in at if w[1] is not None]] if ends}
        for w in at:
            found[w].add(piece)
    return dict(found)


def pattern(pieces: set[str], adapter: Single) -> str:
    """A regular expression for any of the pieces, with the letters that count as equal."""
    letter = lambda c: f"[{re.escape(matching_letters(c, adapter.adapter_wildcards, adapter.read_wildcards))}]"
    return "|".join("".join(map(letter, p)) for p in sorted(pieces))
