"""Findings of files that differ only in numbers that no rule reads: told once for each shape of a text.

A text is cut at its numbers (``NUMBERS``: the digits that end a name, six or more; in the C family also those that stand alone, four or
more). What lies between them is its shape. ``source.traced`` says which places of a text its rules read; texts of one shape with the same
numbers at those places have the same findings but for the evidence, which is taken from each text. Exact, as the rest of a reading
depends on no digit: brackets, names, strings and comments begin and end where they did, names that end in six digits or more are in no
table, and where a rule might look at such a name's digits or compare it with another, everything counts as read.
"""

from __future__ import annotations

import re

from . import source

_ENDS = r"(?<=[A-Za-z_][0-9])[0-9]{5,}"  # the first digit is matched before, so that a search skips what is no digit
_ALONE = r"(?<![\w.$][0-9])[0-9]{3,}"
_C_FAMILY = re.compile(rf"([0-9](?:{_ALONE}|{_ENDS})(?![\w$]))")
NUMBERS = {"java": _C_FAMILY, "go": _C_FAMILY, "js": _C_FAMILY, "python": re.compile(rf"([0-9]{_ENDS}(?!\w))")}
LONGEST = 16_000  # characters of a text that is remembered
SHAPES = 1_000  # with the findings of all their numbers, at most
VALUES = 4_000
_NAME = re.compile(r"(?:^|[^\w\\.])[A-Za-z_]+$")


class Told:
    """Findings without their evidence, a list for each field."""

    __slots__ = ("lines", "columns", "found")

    def __init__(self, found: list[dict]):
        self.found, self.lines, self.columns = found, [f["line"] for f in found], {}

    def column(self, field: str) -> list:
        if field not in self.columns:
            self.columns[field] = [list(x.items()) if field == "extra" and (x := f.get(field)) else f.get(field) for f in self.found]
        return self.columns[field]

    def evidence(self, text: str) -> list[str]:
        lines = text.split("\n")
        return [source.evidence(lines[i - 1]) for i in self.lines]


def read_numbers(lang: str, parts: list[str], reads: list[tuple[int, int]] | None) -> list[int]:
    """Which numbers of a text, cut into ``parts``, lie in the places that were read (all for None)."""
    every = list(range(len(parts) // 2))
    if reads is None or (lang == "python" and not all(_NAME.search(x) for x in parts[:-1:2])):
        return every
    out, at = [], 0
    for i in every:
        at += len(parts[2 * i])
        end = at + len(parts[2 * i + 1])
        if any(a <= end and at <= b for a, b in reads):
            out.append(i)
        at = end
    return out


class Shapes:
    """What a worker remembers; forgotten as a whole when it is full."""

    def __init__(self):
        self.known: dict[tuple, tuple[list[int], dict[tuple, Told]]] = {}
        self.values = 0

    def detect(self, lang: str, text: str) -> tuple[Told, str | None]:
        """``source.detect``, remembered. Errors never are."""
        numbers = NUMBERS.get(lang)
        if numbers is None or len(text) > LONGEST:
            return self._plain(lang, text)
        parts = numbers.split(text)
        shape = (lang, *parts[::2])
        read, told = self.known.get(shape, ((), None))
        if told and (t := told.get(tuple([parts[2 * i + 1] for i in read]))):
            return t, None
        found, error, reads = source.traced(lang, text)
        t = Told(found)
        if error is None:
            if self.values >= VALUES or len(self.known) >= SHAPES:
                self.known.clear()
                self.values, read, told = 0, (), None
            now = sorted({*read, *read_numbers(lang, parts, reads)})
            if told is None or now != read:  # what was told under fewer numbers is told again
                self.values -= len(told or ())
                self.known[shape] = now, (told := {})
            told[tuple([parts[2 * i + 1] for i in now])] = t
            self.values += 1
        return t, error

    @staticmethod
    def _plain(lang: str, text: str) -> tuple[Told, str | None]:
        found, error = source.detect(lang, text)
        return Told(found), error


SHARED = Shapes()  # one a worker
