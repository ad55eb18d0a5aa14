"""Patterns from plain phrases: how rule packs write labels, verbs and distances."""

from __future__ import annotations

from functools import cache
from re import _constants as C
from re import _parser

#: Letters that texts write with or without their accent.
ACCENTS = {"á": "[áa]", "à": "[àa]", "â": "[âa]", "ã": "[ãa]", "ç": "[çc]", "é": "[ée]", "ê": "[êe]", "í": "[íi]", "ó": "[óo]", "ô": "[ôo]", "õ": "[õo]", "ú": "[úu]"}


def phrase(words: str) -> str:
    """A regex for the words: any white space between them, accents optional, ``@`` for either gender's ending, ``…`` for the rest of a word.

    A word in round brackets is optional.
    """
    out = ""
    for k, word in enumerate(words.split()):
        optional = word[0] == "(" and word[-1] == ")"
        body = "".join(ACCENTS.get(c, {"@": "[oa]", "…": r"[\wÀ-ú]*", ".": r"\.", "/": "/", "$": r"\$"}.get(c, c)) for c in word.strip("()"))
        last = k == len(words.split()) - 1
        out += (rf"(?:{body}{'' if last else chr(92) + 's+'})?" if optional else body + ("" if last else r"\s+"))
    return out


def either(*phrases: str) -> str:
    return f"(?:{'|'.join(map(phrase, phrases))})"


def labelled(label: str, value: str, sign: str = r"\s*[:\-]?\s*") -> str:
    """A label, a sign between, the value."""
    return phrase(label) + sign + value


def within(chars: int) -> str:
    """At most so many characters of a line."""
    return rf"[^\n]{{0,{chars}}}?"


def cell(label: str, value: str) -> str:
    """A table's cell behind that of its label."""
    return rf"\|\s*{phrase(label)}\s*\|\s*{value}"


def spaced_letters(word: str) -> str:
    """A word whose letters may stand apart, as headings are set."""
    return r"\s*".join(ACCENTS.get(c, c) for c in word)


@cache
def signs(pattern: str, most: int = 2, alternatives: int = 40) -> tuple[tuple[str, ...], ...]:
    """Sets of lower-case ASCII strings: a text that matches the regex holds one of each set, whatever its case. The surest sets, perhaps none."""
    try:
        sets = _sets(_parser.parse(pattern))
    except Exception:  # what only Java's regexes know
        return ()
    return tuple(tuple(sorted(s)) for s in sorted(sets, key=_sure, reverse=True)[:most] if len(s) <= alternatives)


def _sure(strings: frozenset[str]) -> tuple[int, int]:
    return min(4, min(map(len, strings))), -len(strings)


def _sets(items) -> list[frozenset[str]]:
    out, run = [], ""

    def walk(parts) -> None:
        nonlocal run

        def cut() -> None:
            nonlocal run
            if len(run) > 1:
                out.append(frozenset([run]))
            run = ""

        for op, av in parts:
            if op is C.LITERAL and av < 128:
                run += chr(av).lower()
            elif op is C.SUBPATTERN:
                walk(av[3])
            else:
                cut()
                if op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[0] > 0:
                    out.extend(_sets(av[2]))
                elif op is C.BRANCH:
                    each = [_sets(x) for x in av[1]]
                    if all(each):
                        out.append(frozenset().union(*(max(x, key=_sure) for x in each)))
        if parts is items:
            cut()

    walk(items)
    return out
