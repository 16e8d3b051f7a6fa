"""Patterns written for Python's ``re``, as Java patterns with the same meaning.

Differences that matter: Java's ``\\b`` counts combining marks as word characters and leaves
out numerals such as a superscript two, its ``\\s`` leaves out the four separators U+001C to
U+001F, and its ``.`` and ``$`` know more line ends than the newline.
"""

from __future__ import annotations

_WORD = r"[\p{L}\p{N}_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java(pattern: str, ignore_case: bool = False) -> str:
    flags = "(?iuUd)" if ignore_case else "(?Ud)"
    return flags + pattern.replace(r"\b", _BOUNDARY).replace(r"\s", r"[\s\x1c-\x1f]")


def literal(text: str) -> str:
    """A Spark SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
