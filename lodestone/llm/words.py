"""Texts as words: markup and invisible characters out, then NFKC and case folding, then runs of letters or digits."""

from __future__ import annotations

import re
import unicodedata

MARKUP = re.compile(r"<[^>]*>")
#: Characters that take no room. U+200B U+200C U+200D U+2060 U+FEFF U+00AD
INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """The text as it is compared; null-like texts give an empty one."""
    if not text:
        return ""
    if "<" in text:
        text = MARKUP.sub(" ", text)
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).casefold()


def words(text: str) -> list[str]:
    return WORD.findall(plain(text))
