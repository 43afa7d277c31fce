"""Which letters of a read count as equal to a letter of an adapter."""

from __future__ import annotations

from functools import cache

import numpy as np

# The bases that each letter stands for (nucleotide ambiguity codes); X stands for none.
AMBIGUITY = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "X": "",
}
#: What letters outside the plain alphabet stand for; N stands for it too.
OTHER = "other"


@cache
def bases(wildcards: bool) -> dict[str, frozenset[str]]:
    """The bases of each ASCII letter, in upper or lower case: with wildcards by the codes, else those of A, C, G, T, U alone."""
    plain = {c: frozenset(AMBIGUITY[c]) for c in "ACGTU"}
    codes = {c: frozenset(b) | ({OTHER} if c == "N" else set()) for c, b in AMBIGUITY.items()}
    known = codes if wildcards else plain
    return {chr(k): known.get(chr(k).upper(), frozenset() if wildcards else frozenset([OTHER])) for k in range(256)}


def equal(adapter: str, read: str, adapter_wildcards: bool, read_wildcards: bool) -> bool:
    if not adapter_wildcards and not read_wildcards:
        return adapter.upper() == read.upper()
    return bool(bases(adapter_wildcards)[adapter] & bases(read_wildcards)[read])


@cache
def matching_letters(letter: str, adapter_wildcards: bool, read_wildcards: bool) -> str:
    return "".join(chr(k) for k in range(33, 127) if equal(letter, chr(k), adapter_wildcards, read_wildcards))


@cache
def match_table(sequence: str, adapter_wildcards: bool, read_wildcards: bool) -> np.ndarray:
    """[place in the adapter, byte of the read]: whether they are equal."""
    return np.array([[equal(c, chr(k), adapter_wildcards, read_wildcards) for k in range(256)] for c in sequence], bool)
