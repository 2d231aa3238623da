r"""The rule tables with word boundaries fixed to ASCII.

``\b`` means "between an ASCII word character and anything else" in the rules.
Older Java versions also count accented letters as word characters, which would
change results with the JVM.  Here every ``\b`` becomes look-arounds over ``\w``
(ASCII in Java); where one side is known, the cheaper single look-around is used.
"""

from __future__ import annotations

import re
from typing import Any

from gatewright import dims

_START, _END = r"(?<!\w)", r"(?!\w)"
_EITHER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
# What follows starts with a word character.
_WORD_NEXT = re.compile(r"[A-Za-z0-9_]|\\d|\((?:\?:)?[A-Za-z0-9_\[]|\[[0-9A-Za-z]")
_BOUNDARY = re.compile(r"(?<!\\)((?:\\\\)*)\\b")


def ascii_boundaries(pattern: str) -> str:
    def swap(m: re.Match) -> str:
        before, after = pattern[: m.start()] + m.group(1), pattern[m.end() :]
        before = re.sub(r"\(\?[a-z]+\)\Z", "", before)  # inline flags are not text
        if re.search(r"(?<!\\)[A-Za-z0-9_]\Z", before):
            return m.group(1) + _END
        if _WORD_NEXT.match(after) and not re.search(r"[\])+*?}.]\Z", before):
            return m.group(1) + _START
        return m.group(1) + _EITHER

    return _BOUNDARY.sub(swap, pattern)


def convert(value: Any) -> Any:
    if isinstance(value, str):
        return ascii_boundaries(value) if "\\b" in value else value
    if isinstance(value, dict):
        return {k: convert(v) for k, v in value.items()}
    if isinstance(value, list):
        return [convert(v) for v in value]
    if isinstance(value, tuple):
        return tuple(convert(v) for v in value)
    return value


class _Rules:
    """`gatewright.dims` with converted patterns."""

    def __init__(self) -> None:
        for name in dir(dims):
            if name.isupper():
                setattr(self, name, convert(getattr(dims, name)))


RULES = _Rules()
