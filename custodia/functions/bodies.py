"""Bodies between braces, which have no column form."""

from __future__ import annotations

import regex

_SKIPPED = regex.compile(r"\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|`(?:[^`\\]|\\.)*+`|//[^\n]*|/\*.*?\*/|[{}]", regex.S)


def body_from(text: str, start: int) -> str:
    """The text from the first opening brace at or after ``start`` to its partner; to the end if that is missing; nothing without a brace."""
    depth, begin = 0, -1
    for found in _SKIPPED.finditer(text, start):
        token = found.group()
        if token == "{":
            if not depth:
                begin = found.start()
            depth += 1
        elif token == "}" and depth:
            depth -= 1
            if not depth:
                return text[begin : found.end()]
    return text[begin:] if begin >= 0 else ""


def declared_bodies(text: str, pattern: str) -> list[tuple[int, str, int]]:
    """Ordinal, name and characters of the body of each function that ``pattern`` finds, of each name the first."""
    out: dict[str, int] = {}
    for found in regex.finditer(pattern, text):
        if found[1] not in out:
            out[found[1]] = len(body_from(text, found.end(1)))
    return [(k, name, size) for k, (name, size) in enumerate(out.items())]
