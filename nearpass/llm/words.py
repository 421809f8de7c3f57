"""Words and sentences of raw text."""

from __future__ import annotations

import re
import unicodedata

_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
_BREAK_HYPHEN = re.compile("[-‐‑](?:\r\n|[\n\r\x0b\x0c\x85  ])")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"(?<=[.?!])[\"'”’»)\]]*\s+|\n\s*\n")
#: No text holds a lone surrogate.
SENTENCE_END = "\ud800"
_END_MARK = re.compile(r"[.?!][\"'”’»)\]]*\s+|\n\s*\n")
_MARKED = re.compile(r"[^\W_]+|\ud800")


def joined(text: str) -> str:
    """Text without invisible characters and without hyphens that only break a line."""
    return _BREAK_HYPHEN.sub("", text if text.isascii() else _INVISIBLE.sub("", text))


def word_runs(plain: str) -> list[str]:
    """Longest runs of letters and digits of normalised text."""
    return _WORD.findall(plain)


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits after NFKC and case folding; none for null."""
    if not text:
        return []
    return word_runs(unicodedata.normalize("NFKC", joined(text)).casefold())


def marked_words(plain: str) -> list[str]:
    """``word_runs`` with a mark wherever ``split_sentences`` cuts."""
    return _MARKED.findall(_END_MARK.sub(SENTENCE_END, plain))


def split_sentences(plain: str) -> list[str]:
    """Pieces that end in a full stop, question or exclamation mark, or at an empty line."""
    return [s for s in _END.split(plain) if s and not s.isspace()]
