"""Long alternations, written so that a scan tests few of their words at each place.

Java tries the alternatives of a pattern one after the other at every
character.  Sorted by first letter behind one look at that letter, a text
meets only those that can begin there.  What is found stays the same; which
alternative is met first does not, so this is for tests only, not for groups.
"""

from __future__ import annotations

import re
from functools import lru_cache

FEWEST = 3  # alternatives worth sorting
QUANTIFIER = "?*+{"
LETTERS_A_LOOK = 5  # first letters tried one after the other


def _end_of(pattern: str, at: int) -> int:
    """Place after the character, escape, class or group that begins at ``at``."""
    if pattern[at] == "\\":
        return at + 2 if pattern[at + 1] not in "pP" or pattern[at + 2] != "{" else pattern.index("}", at) + 1
    if pattern[at] == "[":
        at += 1
        while pattern[at] != "]":
            at = _end_of(pattern, at)
        return at + 1
    if pattern[at] == "(":
        at += 1
        while pattern[at] != ")":
            at = _end_of(pattern, at)
        return at + 1
    return at + 1


def _plain_group(pattern: str) -> str | None:
    """What is inside the group that ``pattern`` begins with, if nothing repeats it."""
    if not pattern.startswith("(") or (pattern.startswith("(?") and not pattern.startswith("(?:")):
        return None
    end = _end_of(pattern, 0)
    return None if pattern[end:end + 1] and pattern[end] in QUANTIFIER else pattern[3 if pattern[1] == "?" else 1:end - 1]


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, those of a group that is a whole alternative among them."""
    parts, start, at = [], 0, 0
    while at < len(pattern):
        if pattern[at] == "|":
            parts.append(pattern[start:at])
            start = at = at + 1
        else:
            at = _end_of(pattern, at)
    parts.append(pattern[start:])
    if len(parts) == 1 and (inside := _plain_group(pattern)) is not None and _end_of(pattern, 0) == len(pattern):
        return alternatives(inside)
    return parts if len(parts) == 1 else [a for part in parts for a in alternatives(part)]


def _is_word(char: str) -> bool:
    return char.isascii() and (char.isalnum() or char == " ")


def _first(part: str) -> frozenset[str] | None:
    """Members of a class that holds every character ``part`` can begin with, or None if that is not plain to see."""
    part = part.removeprefix(r"\b")
    while part.startswith("(?<!"):  # looks back, so what follows is still the first character
        part = part[_end_of(part, 0):]
    if (inside := _plain_group(part)) is not None:
        found = [_first(a) for a in alternatives(inside)]
        return None if None in found else frozenset().union(*found)
    end = _end_of(part, 0) if part else 0
    if not part or (part[end:end + 1] and part[end] in "?*") or part[end:end + 2] == "{0":
        return None
    plain = part[:end] == r"\d" or _is_word(part[0]) or re.fullmatch(r"/|\\[^A-Za-z0-9]", part[:end])
    return frozenset([part[:end]]) if plain else None


def _sorted_by_first(parts: list[str]) -> tuple[str, str]:
    """A look at the first character, and the alternatives ``parts`` by that character."""
    by_letter: dict[str, list[str]] = {}
    whole = []
    for part in parts:
        if _is_word(part[0]) and part[1:2] not in tuple(QUANTIFIER):
            by_letter.setdefault(part[0], []).append(part[1:])
        else:
            whole.append(part)
    words = [letter + (rest[0] if len(rest) == 1 else f"(?:{'|'.join(rest)})") for letter, rest in sorted(by_letter.items())]
    if len(words) > LETTERS_A_LOOK:
        runs = [words[i:i + LETTERS_A_LOOK] for i in range(0, len(words), LETTERS_A_LOOK)]
        words = [f"(?=[{''.join(word[0] for word in run)}])(?:{'|'.join(run)})" for run in runs]
    firsts = sorted(set(by_letter).union(*[_first(part) for part in whole]))
    return f"(?=[{''.join(firsts)}])", f"(?:{'|'.join(words + whole)})"


@lru_cache(maxsize=1024)
def quick(pattern: str) -> str:
    """A pattern found in the same texts as ``pattern``, without groups that can be asked for."""
    if re.search(r"\\[1-9Q]|\(\?[a-z]+[:)]|&&", pattern):
        return pattern
    parts = alternatives(pattern)
    if len(parts) == 1:
        border = r"\b" if pattern.startswith(r"\b") else ""
        inside = _plain_group(pattern[len(border):])
        if inside is not None and len(alternatives(inside)) >= FEWEST and None not in map(_first, alternatives(inside)):
            look, words = _sorted_by_first(alternatives(inside))
            return look + border + words + pattern[len(border) + _end_of(pattern[len(border):], 0):]
        first = _first(pattern) if border else None
        return pattern if first is None else f"(?=[{''.join(sorted(first))}]){pattern}"
    if len(parts) < FEWEST:
        return pattern
    kinds: dict[str, list[str]] = {r"\b": [], "": [], "other": []}
    for part in parts:
        border = r"\b" if part.startswith(r"\b") else ""
        if _first(part[len(border):]) is None:
            kinds["other"].append(part)
        else:
            kinds[border].append(part[len(border):])
    found = [look + border + words for border in (r"\b", "") if kinds[border] for look, words in [_sorted_by_first(kinds[border])]]
    if len(found) == 2 and not kinds["other"]:
        # a place where neither kind can begin is left after one look
        firsts = frozenset().union(*[_first(part) for border in (r"\b", "") for part in kinds[border]])
        return f"(?=[{''.join(sorted(firsts))}])(?:{'|'.join(found)})"
    return "|".join(found + kinds["other"])
