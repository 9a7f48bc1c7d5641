"""How the tokenizers library sees characters, where Python sees them otherwise.

Unicode grows: which characters are letters, numbers or upper case depends on the version a library was built with. The driver asks the
library once about every code point and hands the tasks those that differ, so that pieces are cut and lowered as the library does.
"""

from __future__ import annotations

import re
import unicodedata

import regex
from tokenizers import Regex, normalizers, pre_tokenizers

from urbanpulse.llm.text import kept

ASKED = 65_536  # code points asked about at a time


def lowered(text: str) -> str:
    """NFC, then lower case character by character (no final sigma), in Python's version of Unicode."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def every_character() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def seen_as(kind: str, characters: str) -> set[str]:
    """The characters that the library's patterns count as this kind."""
    split = pre_tokenizers.Split(Regex(f"[{kind}]"), "removed", invert=True)
    found: set[str] = set()
    for a in range(0, len(characters), ASKED):
        for piece, _ in split.pre_tokenize_str("\0".join(characters[a:a + ASKED])):
            found.update(piece)
    return found


class Spelling:
    """Characters that differ: `stand_in` for those of another kind, `odd` for those that are lowered otherwise."""

    def __init__(self):
        characters = every_character()
        letters, numbers = (seen_as(kind, characters) for kind in (r"\p{L}", r"\p{N}"))
        differ = letters ^ set(regex.findall(r"\p{L}", characters)) | numbers ^ set(regex.findall(r"\p{N}", characters))
        differ |= letters ^ {c for c in characters if c.isalpha()}
        self.stand_in = {ord(c): "a" if c in letters else "1" if c in numbers else "!" for c in differ}
        ask = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.odd = "".join(c for c in characters if ord(c) > 127 and ask(c) != lowered(c))

    def normalise(self, text: str) -> str:
        """NFC and lower case as the library has them."""
        if text.isascii() or not (self.odd and kept(("odd", self.odd), lambda: re.compile(f"[{re.escape(self.odd)}]")).search(text)):
            return lowered(text)
        return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)

    def cut(self, piece: str, pattern: regex.Pattern) -> list[str]:
        """What the pattern finds in a piece; a piece of letters only is one word."""
        if piece.isascii() or (seen := piece.translate(self.stand_in)) == piece:
            return [piece] if piece.isalpha() else pattern.findall(piece)
        return [piece[m.start():m.end()] for m in pattern.finditer(seen)]


def spelling() -> Spelling:
    """Asked for on the driver, once in a session."""
    return kept(("spelling",), Spelling)
