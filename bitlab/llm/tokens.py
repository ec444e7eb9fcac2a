"""Public tokenizers on executors: exact ids, with the ids of recurring units kept per worker."""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

#: A unit ends before ASCII white space, or with a run of Latin letters that an ASCII non-letter
#: follows. Both tokenizers split at these places whatever stands around them, and look no
#: further back, so a text's ids are its units' ids end to end. Letters: A to Z, a to z and U+00C0
#: to U+024F without U+0130, whose lower case ends with a combining mark.
_LETTERS = "[A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x12F), (0x131, 0x24F))) + "]++"
_UNIT = _LETTERS + r"(?![^\x00-\x7f])|[^\x20\x09-\x0D]+"
LEADING = re.compile(rf"[\x20\x09-\x0D]*(?:{_UNIT})|[\x20\x09-\x0D]+")
BARE = re.compile(_UNIT)
#: White space beyond ASCII, and what some libraries take for it: such texts are encoded whole.
ODD = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + "]")
WORD = re.compile(rf" ?{_LETTERS}")
MAX_UNITS = 600_000
MAX_UNIT_CHARS = 64


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the others follow U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Units(dict):
    """The ids of units as little-endian unsigned 32-bit integers, encoded when first asked for.

    A word of letters is one piece to the tokenizer, so it goes straight to the tokenizer's model.
    """

    def __init__(self, tokenizer, spaced: bool):
        super().__init__()
        self.tokenizer, self.model, self.spaced, self.letters = tokenizer, tokenizer.model, spaced, _byte_letters()

    def __missing__(self, unit: str) -> bytes:
        if WORD.fullmatch(unit):
            word = unit if self.spaced else unit.lower()
            ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in word.encode()]))]
        else:
            ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        out = np.array(ids, "<u4").tobytes()
        if len(unit) <= MAX_UNIT_CHARS:
            self[unit] = out
        return out


class Encoder:
    """Whole-text ids of a tokenizer file, equal to ``encode(text, add_special_tokens=False)``.

    Strings of special tokens within a text are ordinary text. ``spaced``: the tokenizer keeps
    white space, as leading part of the word after it (byte-level BPE); otherwise it drops it.
    At most ``MAX_UNITS`` units are kept per worker; the store is emptied when full.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.units = LEADING if spaced else BARE
        self.odd = ODD if spaced else None
        self.known = Units(self.tokenizer, spaced)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        known = self.known
        if len(known) > MAX_UNITS:
            known.clear()
        look, split, odd = known.__getitem__, self.units.findall, self.odd
        return [b"".join(map(look, split(t))) if odd is None or not odd.search(t) else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def vocabulary_of(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


@cache
def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    return Encoder(path, spaced)
