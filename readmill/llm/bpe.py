"""BPE encoding and decoding with the files of the tokenizers library, without that library.

A word's symbols stand in the leaves of a segment tree, each with the rank of the merge of it and its right neighbour.
The root holds the lowest rank and, among equals, the leftmost place; a merge changes three leaves, each in logarithmic
time, and the loop ends when the root holds no rank. The ids of frequent pieces of text and words are remembered, in a
memory of bounded bytes.

Null and empty texts have no tokens. Texts of any length are cut at ASCII white space, and long pieces without it around
digits and marks, which no token crosses, so memory follows the longest word; a single word of a million letters takes n log n steps. Equal rows give equal results, extra
columns are dropped, an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from readmill.llm.common import Remembered, map_batches, rows, safe_parts, utf8

_NONE = 1 << 100
#: Bytes for the memory of pieces and for that of words; longer ones than SHORT aren't remembered.
PIECES, WORDS, SHORT = 32 << 20, 88 << 20, 64
#: White space as the library's pattern engine sees it (Unicode White_Space).
_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def byte_letters() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies: itself if it prints, else the next free letter from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(free)) for b in range(256)]


class PairTree:
    """Merges of adjacent pairs, as rank << 64 | new id << 32 | place: the least is the lowest rank, leftmost first."""

    def __init__(self, leaves: list[int]):
        size = self.size = 1 << max(0, len(leaves) - 1).bit_length()
        tree = self.tree = [_NONE] * size + leaves + [_NONE] * (size - len(leaves))
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

    def put(self, place: int, leaf: int) -> None:
        tree, k = self.tree, place + self.size
        tree[k] = leaf
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            least = leaf if leaf < other else other
            if tree[k] == least:
                return
            tree[k] = leaf = least


class Bpe:
    """The encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pieces: int = PIECES, words: int = WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges[self.vocab[a] << 32 | self.vocab[b]] = rank << 64 | self.vocab[a + b] << 32
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.cut_special = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACE}"))
        self.letters = byte_letters()
        self.path, self.tables = path, None
        self.pieces, self.words = Remembered(pieces), Remembered(words)

    def _merge(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        get = self.merges.get
        found = [get(a << 32 | b) for a, b in zip(ids, ids[1:])]
        tree = PairTree([_NONE if m is None else m | i for i, m in enumerate(found)])
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree.tree[1]) < _NONE:
            i = top & 0xFFFFFFFF
            j = right[i]
            ids[i], ids[j] = top >> 32 & 0xFFFFFFFF, -1
            after = right[i] = right[j]
            if j < n - 1:
                tree.put(j, _NONE)
            if after < n:
                left[after] = i
                m = get(ids[i] << 32 | ids[after])
                tree.put(i, _NONE if m is None else m | i)
            elif i < n - 1:
                tree.put(i, _NONE)
            if (before := left[i]) >= 0:
                m = get(ids[before] << 32 | ids[i])
                tree.put(before, _NONE if m is None else m | before)
        return [x for x in ids if x >= 0]

    def _words(self, text: str) -> list[str]:
        """The byte-level words of a text. Where it has characters newer than Python's Unicode tables, the library's tables cut it."""
        if text.isascii():
            found = self.pattern.findall(text.lower())  # printable ASCII stands for itself
            return found if text.isprintable() else ["".join([self.letters[b] for b in w.encode()]) for w in found]
        if max(text) > "\u052f" and any(unicodedata.category(c) == "Cn" for c in text):
            if self.tables is None:
                from tokenizers import Tokenizer

                self.tables = Tokenizer.from_file(self.path)
            return [w for w, _ in self.tables.pre_tokenizer.pre_tokenize_str(self.tables.normalizer.normalize_str(text))]
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)  # letter by letter: no final sigma
        letters = self.letters
        return [w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in self.pattern.findall(text)]

    def _word(self, word: str) -> tuple[int, ...]:
        memo = self.words
        ids = memo.now.get(word) or memo.seen(word)
        if ids is None:
            symbols = list(word)
            symbols[-1] += self.suffix
            ids = tuple(self._merge([self.vocab[s] for s in symbols]))
            if len(word) <= SHORT:
                memo.put(word, ids, 8 * len(ids))
        return ids

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self._words(text):
            out += self._word(word)
        return out

    def piece(self, piece: bytes) -> bytes:
        """The ids of a piece between white space, as little-endian unsigned 32-bit integers."""
        if piece.isalpha() and len(piece) <= SHORT:  # ASCII letters are one word
            ids = self._word(piece.lower().decode())
            return struct.pack(f"<{len(ids)}I", *ids)
        out = []
        for part in safe_parts(piece):
            text = part.decode()
            if self.cut_special is None or "<" not in text:
                ids = self._plain(text)
            else:
                ids = []
                for k, some in enumerate(self.cut_special.split(text)):
                    ids += [self.special[some]] if k % 2 else self._plain(some)
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        memo, cut = self.pieces, text.split()
        got = list(map(memo.now.get, cut))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    p = cut[i]
                    x = memo.now.get(p) or memo.seen(p)
                    if x is None:
                        x = self.piece(p)
                        if len(p) <= SHORT:
                            memo.put(p, x, len(x))
                    got[i] = x
        return b"".join(got)

    def decode(self, ids: bytes, step: int = 1 << 16) -> str:
        """The vocabulary file names no decoder: tokens are joined by one blank."""
        numbers, tokens = np.frombuffer(ids, "<u4"), self.tokens
        return " ".join([" ".join([tokens[i] for i in numbers[a : a + step].tolist()]) for a in range(0, len(numbers), step)])


_open: dict[str, Bpe] = {}


def opened(path: str) -> Bpe:
    """One encoder a worker process and file."""
    if path not in _open:
        _open[path] = Bpe(path)
    return _open[path]


def encode(docs: DataFrame, vocabulary: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary, little-endian u32) and decoded, of each document."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary()), ("decoded", pa.string())] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(vocabulary)
        for batch in batches:
            done: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text")):
                ids = bpe.encode(text)
                decoded = bpe.decode(ids)
                done.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *((ids, decoded) if keep_ids else ())))
            if done:
                yield rows(out, list(zip(*done)))

    return map_batches(docs.select("doc_id", "text"), run, schema)
