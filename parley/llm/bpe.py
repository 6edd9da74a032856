"""Byte-level BPE encoding with the tokenizers library, memoised at safe text boundaries.

The vocabulary's pre-tokenizer never lets a piece run from a non-space character into a following
space, so a text may be cut before any single space that stands between two non-space characters:
encoding the parts one after another gives the ids of the whole. Most parts are words seen before.
"""

from __future__ import annotations

import functools
import os
import re
import string
from array import array

import numpy as np

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than spaces and line breaks; a text with any of it takes the careful path.
_RARE = [*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]


def _shown() -> dict[int, str]:
    """Byte -> the printable character that byte-level vocabularies write for it."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SHOWN = _shown()


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _parts(text: str) -> list[str]:
    """The text cut before every space that stands alone between non-space characters."""
    odd = text[0] == " " or text[-1] == " " or " \n" in text or "\n " in text or any(c in text for c in (_RARE[:8] if text.isascii() else _RARE))
    parts = None if odd else text.split(" ")
    return _CUT.split(text) if parts is None or "" in parts else parts


#: What Python takes for one remembered part besides its characters and ids.
_ENTRY = 240
_LONGEST = 64


class _Memo(dict):
    """A dictionary that asks ``learn`` for what it lacks and keeps the answer, but for parts of several lines and long ones."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.held = learn, 0

    def __missing__(self, part: str) -> bytes:
        got = self.learn(part)
        if len(part) <= _LONGEST and "\n" not in part:
            self[part] = got
            self.held += 2 * len(part) + _ENTRY
        return got


class MemoEncoder:
    """Text -> little-endian uint32 ids as bytes, the same as the library's plain call on the whole text.

    ``most_bytes`` bounds the memory of remembered parts. The vocabulary's added tokens are ids of their own
    wherever their strings stand in a text, as the library has it; a text is cut at them first.
    """

    def __init__(self, path: str, most_bytes: int = 288 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merges = self.tok.model.tokenize  # the merges alone, on one piece in shown bytes
        self.most = most_bytes
        self.after = _Memo(lambda p: self._learn(p, " ", self.after))  # parts that follow a space
        self.alone = _Memo(lambda p: self._learn(p, "", self.alone))  # parts that open a text or a line
        self.tails = _Memo(self.plain)
        self.line_break = self.plain("\n")
        added = {t.content: (int(i).to_bytes(4, "little"), t.lstrip or t.rstrip or t.single_word or t.normalized) for i, t in self.tok.get_added_tokens_decoder().items()}
        self.added = {a: raw for a, (raw, _) in added.items()}
        self.bends = any(bends for _, bends in added.values())  # such tokens look at their surroundings
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def plain(self, text: str) -> bytes:
        """The library's ids of a whole text."""
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, part: str, lead: str, memo: _Memo) -> bytes:
        """The ids of a part with ``lead`` before it.

        Letters or digits, with ASCII punctuation after them or not, are one piece and its tail to the
        pre-tokenizer, so such pieces go straight to the library's merges. A line break between two
        non-space characters is a piece of its own. Other parts take the whole pipeline.
        """
        stem = part if part.isalpha() else part.rstrip(string.punctuation)
        if stem.isalpha() or stem.isdecimal():
            if len(stem) < len(part):
                return memo[stem] + self.tails[part[len(stem) :]]
            if stem.isascii():  # ASCII letters and digits are shown as they are
                shown = _SHOWN[32] + stem if lead else stem
            else:
                shown = (lead + stem).encode().decode("latin-1").translate(_SHOWN)
            return array("I", [t.id for t in self.merges(shown)]).tobytes()
        lines = part.split("\n")
        if len(lines) > 1 and not any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            return self.line_break.join([memo[lines[0]], *map(self.alone.__getitem__, lines[1:])])
        return self.plain(lead + part)

    def encode(self, text: str) -> bytes:
        memos = (self.after, self.alone, self.tails)
        if sum(m.held for m in memos) > self.most:
            for m in memos:
                m.clear()
                m.held = 0
        if not any(a in text for a in self.added):
            return self._encode(text)
        if self.bends:
            return self.plain(text)
        return b"".join(self.added[p] if p in self.added else self._encode(p) for p in self.at_added.split(text))

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = _parts(text)
        return self.alone[first] + b"".join(map(self.after.__getitem__, rest))


@functools.cache
def most_id(path: str) -> int:
    """The largest id of a vocabulary, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


REMEMBERED_BYTES = 288 << 20

_ENCODERS: dict[tuple[str, int], MemoEncoder] = {}


def forget() -> None:
    """Give back this worker's encoder and all that it remembers."""
    _ENCODERS.clear()


def encoder(path: str, most_bytes: int = REMEMBERED_BYTES) -> MemoEncoder:
    """One encoder for each Python worker and vocabulary."""
    key = (path, most_bytes)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = MemoEncoder(path, most_bytes)
    return _ENCODERS[key]
