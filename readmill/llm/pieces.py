r"""Pieces of text that a vocabulary of the tokenizers library encodes one by one.

Some vocabularies drop white space and cut a text before they merge: at ASCII white space, around each digit, and between
letters and marks of punctuation. For these a text's ids are those of its pieces put together, pieces can be remembered, and
texts without white space can be cut where they are long. Whether a vocabulary is of this kind is found by trying; the
others encode whole texts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

from tokenizers import Tokenizer

from readmill.llm.bpe import byte_letters
from readmill.llm.common import Remembered, safe_parts

#: Longer pieces aren't remembered.
SHORT = 64
#: Bytes that a worker's memory of pieces may take.
REMEMBERED = 80 << 20
#: Marks that stand apart from letters before them. Not the apostrophe, which some letters go with, nor those of special tokens.
MARKS = b'.,;:!?#$%&*()+-/=@[]^_`{}~"\\'
_PROBES = [("a", " b"), ("a", "\n\tb"), ("1", "2"), ("1", "b"), ("b", "."), ("\u00e9t\u00e9", "..."), ("\u6f22", "\u3002"), ("Word", "\x0bx")]


def by_bytes(pieces: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """The pieces, in lists of about `most` bytes."""
    part, n = [], 0
    for p in pieces:
        part.append(p)
        n += len(p)
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


class Coder:
    """A vocabulary with what is remembered of it."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo = Remembered(REMEMBERED)
        self.letters = byte_letters()
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.cuts = all(ids(a + b) == ids(a) + ids(b) for a, b in _PROBES)
        # the model alone, without normaliser and splitter, for words of which these make nothing else
        self.words = self.cuts and all(ids(w.title() + "...") == self._word(w) + self._word("...") for w in ("word", "\u00e9t\u00e9", "x"))
        self.size = self.tokenizer.get_vocab_size(True)

    def encoded(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return [t.id for t in self.tokenizer.model.tokenize(word)] if word else []

    def _ids(self, piece: bytes, kind: str) -> bytes:
        if self.words and b"<" not in piece:
            core = piece.rstrip(MARKS)
            word = core.decode()
            # Latin letters below U+0250 have no other composed form, and but for U+0130 one small letter each
            if not core or word.isalpha() and (core.isascii() or max(word) < "\u0250" and "\u0130" not in word):
                return array(kind, self._word(word.lower()) + self._word(piece[len(core) :].decode())).tobytes()
        out = array(kind)
        for part in safe_parts(piece):
            out.extend(self.encoded([part])[0])
        return out.tobytes()

    def dtype(self, most: int = 0) -> str:
        """The least unsigned type for the vocabulary's ids and `most`."""
        return "u2" if max(self.size - 1, most) < 1 << 16 else "u4"

    def ids(self, text: bytes, most: int = 0) -> bytes:
        """The ids of a text as unsigned integers of dtype(most)."""
        kind = "H" if self.dtype(most) == "u2" else "I"
        if not self.cuts:
            return array(kind, self.encoded([text])[0]).tobytes()
        cut, memo = text.split(), self.memo
        got = list(map(memo.now.get, cut))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    p = cut[i]
                    x = memo.now.get(p)
                    if x is None:
                        x = memo.older.get(p) or self._ids(p, kind)
                        if len(p) <= SHORT:
                            memo.put(p, x, len(x))
                    got[i] = x
        return b"".join(got)


_open: dict[tuple[str, str], Coder] = {}


def opened(path: str, use: str) -> Coder:
    """One coder a worker process, file and use (ids or counts, which are remembered apart); only the last used is held."""
    if (path, use) not in _open:
        _open.clear()
        _open[path, use] = Coder(path)
    return _open[path, use]
