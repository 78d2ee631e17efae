"""The pre-tokenizing pattern of byte-level vocabularies, and a faster twin for texts of common characters."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Fixed value: contractions, letters, numbers and other characters with a blank before them, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Characters on which all implementations of the pattern agree; texts with others need the pattern itself.
UNCOMMON = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ–—‘’“”…€]")
#: PATTERN on common characters; what begins with a blank or a letter comes first, since most words do.
_COMMON = re.compile(rf" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Function from a text to its matches of the pattern. Only for PATTERN itself are texts of common characters split by the twin."""
    import regex

    whole = regex.compile(pattern)
    if pattern != PATTERN:
        return whole.findall
    return lambda text: whole.findall(text) if UNCOMMON.search(text) else _COMMON.findall(text)
