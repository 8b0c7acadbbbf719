"""Regular expressions with ASCII classes, compiled once.

Patterns are written in a common dialect whose \\d, \\w and \\b mean ASCII, whose \\s includes the no-break and other
Unicode spaces, and whose $ is the end of the text. Case-insensitive patterns still fold letters beyond ASCII.
"""

from __future__ import annotations

from functools import cache

import regex

_SPACES = "\\t\\n\\x0b\\x0c\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_IN_CLASS = {"d": "0-9", "w": "A-Za-z0-9_", "s": _SPACES}
_ALONE = {
    "d": "[0-9]",
    "D": "[^0-9]",
    "w": "[A-Za-z0-9_]",
    "W": "[^A-Za-z0-9_]",
    "s": f"[{_SPACES}]",
    "S": f"[^{_SPACES}]",
    "b": "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))",
}


def translated(pattern: str) -> str:
    """A pattern of the common dialect as one for the regex module."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            names = _IN_CLASS if inside else _ALONE
            out.append(names.get(pattern[i + 1], pattern[i : i + 2]))
            i += 2
            continue
        if c == "[" and inside:
            out.append("\\[")
        elif c == "$" and not inside:
            out.append("\\Z")
        else:
            if c == "[":
                inside = True
            elif c == "]" and inside:
                inside = False
            out.append(c)
        i += 1
    return "".join(out)


def once(pattern: str, ignore_case: bool = False) -> regex.Pattern:
    """A pattern made from a text's own words, which is not kept."""
    return regex.compile(translated(pattern), regex.V0 | (regex.IGNORECASE if ignore_case else 0), cache_pattern=False)


@cache
def rx(pattern: str, ignore_case: bool = False) -> regex.Pattern:
    return once(pattern, ignore_case)


UP = "A-ZĄĆĘŁŃÓŚŹŻ"
LO = "a-ząćęłńóśźż"
#: A capitalised word, perhaps of two parts.
CAP = f"[{UP}][{LO}]+(?:-[{UP}][{LO}]+)?"
#: The same with any number of parts, as places have.
CAP_PLACE = f"[{UP}][{LO}]+(?:-[{UP}][{LO}]+)*"
