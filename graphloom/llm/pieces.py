"""Cutting texts where byte-level BPE pre-tokenisation certainly cuts, so that encodings of pieces can be remembered."""

from __future__ import annotations

import re

_DOUBLE = re.compile(r"\s | \s")
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space other than the space and the line feed.
_OTHERS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _doubled(text: str) -> bool:
    """Whether a space stands beside other white space; the pattern is searched only where there is any but spaces and line feeds."""
    if any(c in text for c in _OTHERS):
        return _DOUBLE.search(text) is not None
    return "  " in text or " \n" in text or "\n " in text


def split_pieces(text: str) -> list[str]:
    """Pieces whose concatenation is the text.

    A cut lies before a single space between two characters that are not white space. The usual byte-level patterns
    begin a pre-token there whatever stands around it, so encoding the pieces one by one encodes the text.
    """
    if _doubled(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    pieces = [" " + x for x in rest]
    return [first, *pieces] if first else pieces


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def latin(word: str) -> bool:
    """Whether a word is of Latin letters only, which every usual pattern takes as one pre-token."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")
