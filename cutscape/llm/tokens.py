"""Token ids of whole texts, faster for repeated words than the tokenizer alone.

The tokenizer treats stretches between white space independently: its normaliser and its splitting pattern never join
characters over a white space, which it drops. So a text's ids are those of its stretches, one after the other, and each
stretch is encoded once and then looked up. Words of letters go straight to the tokenizer's BPE model; all else goes
through its whole pipeline. The memory of stretches is bounded: two generations of at most `keep` entries.

Texts with special tokens' strings, or combining marks with capital letters, are handled without folding their case.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

from tokenizers import Tokenizer

#: Entries of each of the two generations.
KEEP = 200_000
MARKS = b".,;:!?|"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable bytes are themselves, others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, keep: int = KEEP) -> None:
        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model, self.letters = self.tokenizer.model, byte_letters()
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are packed as the machine's unsigned integers, which must be little-endian 32-bit ones")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, stretch: bytes) -> bytes | None:
        """Of a stretch of plain Latin letters, which the pattern keeps in one piece; None of any other."""
        if stretch.isalpha():
            spelled = stretch.lower().decode()
        else:
            word = stretch.decode()
            if not word.isalpha() or max(word) >= "ɐ" or "İ" in word:
                return None
            spelled = word.lower().encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _learn(self, stretch: bytes) -> bytes:
        found = self.old.get(stretch) or self._word(stretch)
        if found is None and stretch[-1] in MARKS and stretch[-2:-1].isalnum():  # a mark after a letter or digit stands alone
            found = self.ids_of(stretch[:-1]) + self.ids_of(stretch[-1:])
        if found is None:
            found = self._whole(stretch.decode())
        if len(self.young) >= self.keep:
            self.old, self.young = self.young, {}
        self.young[stretch] = found
        return found

    def ids_of(self, stretch: bytes) -> bytes:
        found = self.young.get(stretch)
        return self._learn(stretch) if found is None else found

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if b"<|" in text:
            return self._whole(text.decode())
        if b"\xcc" not in text and b"\xcd" not in text:  # no combining marks
            text = text.lower()
        stretches = text.split()
        found = list(map(self.young.get, stretches))
        if None in found:
            found = [self.ids_of(s) if f is None else f for s, f in zip(stretches, found)]
        return b"".join(found)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each path and Python worker; it lives on from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: What goes to the tokenizer itself: characters whose class may differ between versions of Unicode, and special tokens.
RARE = re.compile(r"[^\x00-\u052f\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bf\u2190-\u21ff\u3000-\u303f\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3]|<\|")
#: The splitting pattern of the byte-level pre-tokenizer (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest word and most white space besides one space a word, in characters, that the fast way takes.
ODD = 20_000


class ByteEncoder:
    """Ids of texts by a byte-level BPE tokenizer's file, as little-endian unsigned 32-bit integers.

    Ids that rise in the order of the merges are ranks, with which another library joins bytes twice as fast. It gets the
    vocabulary of this file; texts with special tokens' strings, rare characters, very long words or little but white space go
    through the tokenizer itself. The ids are those of the tokenizer in either case.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = {letter: b for b, letter in byte_letters().items()}
        special = self.tokenizer.get_added_tokens_decoder()
        ranks = {bytes(byte_of[c] for c in word): n for word, n in model["vocab"].items() if n not in special}
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("ids don't rise in the order of the merges")
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        odd = False
        if len(text) > ODD:
            sizes = list(map(len, text.split()))
            odd = max(sizes, default=0) > ODD or len(text) - sum(sizes) - len(sizes) > ODD
        if odd or RARE.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


_BYTE_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for each path and Python worker; it lives on from task to task."""
    if path not in _BYTE_ENCODERS:
        _BYTE_ENCODERS[path] = ByteEncoder(path)
    return _BYTE_ENCODERS[path]
