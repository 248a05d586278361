"""Cutting SQL text without a grammar: quoted parts, brackets, clauses."""

from __future__ import annotations

import re
from collections.abc import Callable

_QUOTED = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/)", re.S)


def outside_quotes(text: str, f: Callable[[str], str]) -> str:
    """text with f applied to the parts outside quotes and comments."""
    return "".join(p if i % 2 else f(p) for i, p in enumerate(_QUOTED.split(text)))


def masked(text: str) -> str:
    """text of the same length with blanks for all within quotes, so that words and brackets can be found by place."""
    return _QUOTED.sub(lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][-1] if m[0][0] in "'\"" else " " * len(m[0]), text)


def closing(mask: str, at: int) -> int:
    """The place of the bracket that closes the one at a place."""
    depth = 0
    for i in range(at, len(mask)):
        depth += (mask[i] in "([") - (mask[i] in ")]")
        if not depth:
            return i
    raise ValueError(f"a bracket isn't closed: {mask[at : at + 40]}")


def split_list(text: str, mark: str = ",") -> list[str]:
    """The items of a list, cut at marks outside brackets and quotes."""
    mask, depth, out, at = masked(text), 0, [], 0
    for i, c in enumerate(mask):
        depth += (c in "([") - (c in ")]")
        if c == mark and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def split_words(text: str, *words: str) -> dict[str, str]:
    """The text before and after each of some clause words outside brackets and quotes, by word in capitals; the start is under an empty name."""
    mask = masked(text)
    flat, depth = [], 0
    for c in mask:
        depth -= c in ")]"
        flat.append(c if not depth else " ")
        depth += c in "(["
    flat_text, found = "".join(flat), []
    for w in words:
        m = re.search(r"(?<!\w)" + w.replace(" ", r"\s+") + r"(?!\w)", flat_text, re.I)
        if m:
            found.append((m.start(), m.end(), w.upper()))
    found.sort()
    out = {"": text[: found[0][0]].strip() if found else text.strip()}
    for (_, end, w), after in zip(found, [*(x[0] for x in found[1:]), len(text)]):
        out[w] = text[end:after].strip()
    return out


def assignments(text: str) -> dict[str, str]:
    """{column: SQL} of a SET list."""
    out = {}
    for item in split_list(text):
        name, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"no assignment: {item}")
        out[name.strip().strip('`"')] = value.strip()
    return out
