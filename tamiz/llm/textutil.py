"""Small text helpers shared by the operators of this subpackage (plain Python, run inside Arrow batches)."""

from __future__ import annotations

import re
import unicodedata

#: Latin letters with marks, mapped in one C call; everything else goes through NFKD.
_LATIN = {}
for _cp in range(0xC0, 0x250):
    _base = "".join(c for c in unicodedata.normalize("NFKD", chr(_cp)) if not unicodedata.combining(c))
    if _base and _base != chr(_cp):
        _LATIN[_cp] = _base
_MARKS = re.compile("[̀-ͯ]")
WORD = re.compile(r"[^\W_]+")


#: The same for texts that fit in one byte a letter: most of them, and quicker.
_ONE_BYTE = bytes(
    ord(_LATIN[ord(c)]) if c and len(_LATIN.get(ord(c), "")) == 1 else k for k, c in ((k, bytes([k]).decode("cp1252", "ignore")) for k in range(256))
)


def strip_accents(text: str) -> str:
    """Letters without their accents; decomposed accents are removed as well."""
    if text.isascii():
        return text
    try:
        return text.encode("cp1252").translate(_ONE_BYTE).decode("cp1252")
    except UnicodeEncodeError:
        return _MARKS.sub("", text.translate(_LATIN))


def fold(text: str) -> str:
    """Lower case, no accents, white space collapsed to one blank."""
    return " ".join(strip_accents(text.lower()).split())
