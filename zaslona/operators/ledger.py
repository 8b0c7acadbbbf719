"""Where each replaced stretch of a text stood at first.

A rule's result is a list of edits (start, end, new text) of the text before it. The ledger keeps the stretches in
which the present text differs from the first one, in order, each with its place in both; all between them is equal,
so a place outside of a stretch differs from its first one by what the stretches before it have added or taken away.
"""

from __future__ import annotations

from typing import NamedTuple

Edit = tuple[int, int, str]


class Stretch(NamedTuple):
    start: int
    end: int
    first_start: int
    first_end: int


def rewritten(text: str, edits: list[Edit]) -> str:
    """The text after edits, which are in order and do not overlap."""
    out, at = [], 0
    for start, end, new in edits:
        out += (text[at:start], new)
        at = end
    return "".join([*out, text[at:]])


class Ledger:
    def __init__(self):
        self.stretches: list[Stretch] = []

    def record(self, edits: list[Edit]) -> None:
        """Edits of the present text, in order. One that overlaps stretches forms one with them."""
        old, new, i, shift, reach = self.stretches, [], 0, 0, -1
        for start, end, text in edits:
            grown = len(text) - (end - start)
            joins = start < reach  # within what the edit before has become part of
            while not joins and i < len(old) and old[i].end <= start:
                new.append(old[i]._replace(start=old[i].start + shift, end=old[i].end + shift))
                i += 1
            behind = old[i - 1].first_end - old[i - 1].end if i else 0
            low, first = start + shift, start + behind
            high, last = end, end + behind
            if joins:
                low, _, first, last = new.pop()
                high = max(end, reach)
                last += high - reach
            elif i < len(old) and old[i].start < start:
                low, first = old[i].start + shift, old[i].first_start
            while i < len(old) and old[i].start < end:
                high = max(high, old[i].end)
                last = old[i].first_end + high - old[i].end
                i += 1
            shift, reach = shift + grown, high
            new.append(Stretch(low, high + shift, first, last))
        self.stretches = new + [s._replace(start=s.start + shift, end=s.end + shift) for s in old[i:]]

    def open(self, places: list[tuple[int, int, str, int, list[Stretch]]]) -> None:
        """Puts the stretches of a text of its own in place of the stretch that stood for it.

        A place is (start and end of what stood for it before the last edits, its text, where it stood at first, its stretches).
        """
        shift = 0
        for start, end, text, first, inner in places:
            own = start + shift, start + shift + len(text)
            shift += len(text) - (end - start)
            for i, s in enumerate(self.stretches):
                if (s.start, s.end) == own:
                    self.stretches[i : i + 1] = [Stretch(own[0] + x.start, own[0] + x.end, first + x.first_start, first + x.first_end) for x in inner]
                    break
