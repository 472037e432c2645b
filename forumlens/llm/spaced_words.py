"""Texts cut into words after single spaces, and byte-level ids of many such words at once."""

from __future__ import annotations

import base64
import os
import re
from itertools import chain

import numpy as np

# White space and what may pass for it: a cut needs a character beside it that is none for certain.
_STRANGE = r"\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
_SPACES = rf"\t\n\r\x20{_STRANGE}"
_strange = re.compile(rf"[{_STRANGE}\u2581]").search
_between = re.compile(r"[\t\n\r] [\t\n\r]").search
_cut = re.compile(rf"(?<=[^{_SPACES}]) (?=[^{_SPACES}])").split
# Characters beyond these belong to classes that differ between the libraries' versions of Unicode.
_foreign = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\u024f\u2010-\u2027]").search
# Bytes of which every strange character has one, and of which every foreign character has one.
_STRANGE_BYTES, _FOREIGN_BYTES = b"\x0b\x0c\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3\xef", re.compile(rb"[\x1c-\x1f\xca-\xff]|\xc9[\x90-\xbf]|\xc2\x85")
# Words up to this many characters are encoded together.
_JOINED = 256


def words_of(raw: bytes) -> list[str]:
    """A text cut at single spaces where neither tokenizer has a token across; each word is a part after a space.

    All spaces cut a text that has no strange or doubled white space and none at its ends; any other text is cut where both
    neighbours of a space are no white space.
    """
    text = raw.decode()
    strange = len(raw.translate(None, _STRANGE_BYTES)) < len(raw) and _strange(text)
    if strange or "  " in text or text[0] == " " or text[-1] == " ":
        return _cut(text)
    lines = " \n" in text or " \t" in text or " \r" in text
    return _cut(text) if lines and _between(text) else text.split(" ")


def visible_bytes() -> dict[str, int]:
    """How a byte-level vocabulary writes bytes: visible ones as themselves, the others from U+0100 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in visible]
    return {chr(byte): byte for byte in visible} | {chr(256 + place): byte for place, byte in enumerate(hidden)}


class SpacedWords:
    """Ids of words after a space by a byte-level vocabulary; strings of control tokens are plain text.

    Words of letters whose class all libraries agree on are joined and encoded in one call by the quicker library, which
    reads the vocabulary as ``ranks``; the others, and all of them without ``ranks``, by the one that reads ``merges``.
    """

    def __init__(self, merges: str, ranks: str | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(merges)
        self.whole.encode_special_tokens = True
        self.latin = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.latin = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        spelled = visible_bytes()
        self.bytes = {number: bytes(map(spelled.get, token)) for token, number in self.whole.get_vocab(False).items()}
        self.sizes = np.zeros(max(self.bytes) + 1, np.int64)
        self.sizes[list(self.bytes)] = list(map(len, self.bytes.values()))

    def sorted_out(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Words that keep their ids when they are joined by spaces, and the others."""
        if self.latin is None:
            return [], words
        edge = " \t\n\r"
        others = {w for w in words if not w or w[0] in edge or w[-1] in edge or len(w) > _JOINED or "  " in w}
        if _FOREIGN_BYTES.search("".join(words).encode()):
            others.update(w for w in words if _foreign(w) or not w.isascii() and _strange(w))
        return ([w for w in words if w not in others] if others else words), list(others)

    def ids(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, their ids one word after the other, and how many each has."""
        plain, others = self.sorted_out(words)
        ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if plain:
            ids = np.array(self.latin.encode_ordinary(f" {' '.join(plain)}"), np.int64)
            ends = np.cumsum(np.array([len(word.encode()) + 1 for word in plain], np.int64))
            counts = np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1, prepend=0)
        if others:
            found = [one.ids for one in self.whole.encode_batch([" " + word for word in others], add_special_tokens=False)]
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), np.int64)])
            counts = np.concatenate([counts, np.array(list(map(len, found)), np.int64)])
        return plain + others, ids, counts
