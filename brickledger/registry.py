"""The project registry: curated names plus the projects a user adds.

A ``Registry`` is immutable.  It only builds Column expressions and small
DataFrames, so the rules reach the executors as literals of the plan.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions.phrases import ODD_CASE, WORDS, Phrase, every_one, folded, is_odd, looked_up
from .functions.projects import NAME_RULES, PROJECT_NAMES, SPELLINGS, TEXT_RULES
from .functions.scans import quick
from .functions.strings import first_filled, found, let
from .functions.unicode import decode_references, plain_letters

RULES_A_SCAN = 8  # tested one by one after a scan for all of them


@dataclass(frozen=True)
class CustomProject:
    name: str
    aliases: tuple[str, ...] = ()

    @staticmethod
    def of(name: str, aliases: Iterable[str] = ()) -> CustomProject:
        return CustomProject(name.strip().upper(), tuple(a.strip() for a in aliases if a.strip()))


def normalise_plain(c: Column) -> Column:
    """Project name form of a text that ``plain_letters`` has already been through."""
    name = F.replace(F.upper(c), F.lit("&"), F.lit(" AND "))
    known = P.any_of(*[pattern for pattern, _ in SPELLINGS])
    return let(F.trim(F.regexp_replace(name, "[^A-Z0-9]+", " ")), lambda words: F.when(
        words.rlike(quick(known)), reduce(lambda n, rule: F.regexp_replace(n, rule[0], rule[1]), SPELLINGS, words)
    ).otherwise(words))


def normalize_project_name(c: Column) -> Column:
    """Upper-case ASCII words with known spellings brought to one form."""
    return normalise_plain(plain_letters(c))


def _normalise_constant(name: str) -> str:
    """``normalize_project_name`` for a registry entry, needed while a plan is built."""
    letters = unicodedata.normalize("NFKD", decode_references(name))
    letters = "".join(ch for ch in letters if not unicodedata.category(ch).startswith("M"))
    words = re.sub("[^A-Z0-9]+", " ", letters.upper().replace("&", " AND ")).strip()
    return reduce(lambda n, rule: re.sub(rule[0], rule[1], n), SPELLINGS, words)


def _phrase(name: str) -> str:
    """Pattern for the words of ``name`` with any blanks between them."""
    return r"\b" + r"\s+".join(re.escape(word) for word in name.split()) + r"\b"


def _first_hit(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Result of the first rule found in ``c``, else null.

    One combined scan rejects the texts that hold no project at all, so only
    real hits pay for the ordered rules.
    """
    if not rules:
        return F.lit(None).cast("string")
    def some(part: list[tuple[str, str]]) -> Column:
        return found(c, P.any_of(*[pattern for pattern, _ in part]))

    def in_order(part: list[tuple[str, str]]) -> Column:
        return reduce(lambda case, rule: case.when(found(c, rule[0]), rule[1]), part, F)

    # the first few that hold a hit also hold the first hit
    parts = [rules[i:i + RULES_A_SCAN] for i in range(0, len(rules), RULES_A_SCAN)]
    return F.when(some(rules), reduce(lambda case, part: case.when(some(part), in_order(part)), parts, F))


def _words_of(name: str) -> list[str]:
    """Words of a name as they are looked up; none if its letters have no plain lower case."""
    low = name.upper().lower()
    if len(low) != len(name) or re.search(ODD_CASE, name):
        return []
    return re.findall("[a-z0-9]+|(?:(?![a-z0-9_])[^\\W])+", "".join(ch if ch.isascii() or unicodedata.category(ch)[0] == "L"
                      or unicodedata.category(ch) == "Nd" else " " for ch in low))


def _first_named(c: Column, names: list[tuple[str, str]]) -> Column:
    """Project of the first of ``(name, project)`` found in a text, words apart and in any case, else null.

    Names are looked up at each word of the text, and those that are met there
    are tested by their pattern.  Names without a word are tested in turn, and
    so are all of them on texts with letters that match others than their
    lower case.
    """
    if not names:
        return F.lit(None).cast("string")
    every = [Phrase(i, tuple(_words_of(name)), P.ci(_phrase(name)), project) for i, (name, project) in enumerate(names)]
    known, others = [p for p in every if p.pieces], [p for p in every if not p.pieces]

    def accept(pattern: Column) -> Column:
        return F.rlike(c, pattern)

    met = looked_up(F.regexp_extract_all(folded(c), F.lit(WORDS), F.lit(0)), known, accept)
    first = F.array_min(F.filter(F.array(met, every_one(others, accept)), lambda e: e.isNotNull())) if others else met
    # one scan for all patterns tells whether an odd text holds any
    in_turn = F.when(c.rlike(P.any_of(*[p.test for p in every])), every_one(every, accept))
    return F.when(is_odd(c), in_turn).otherwise(first)["project"]


@dataclass(frozen=True)
class Registry:
    custom: tuple[CustomProject, ...] = field(default=())

    # -- changes: each returns a new registry ------------------------------

    @staticmethod
    def with_projects(projects: Iterable[CustomProject]) -> Registry:
        """Replace all custom projects; blank and built-in names are left out."""
        cleaned = (CustomProject.of(p.name, p.aliases) for p in projects)
        return Registry(tuple(p for p in cleaned if p.name and p.name not in PROJECT_NAMES))

    def add(self, name: str, aliases: Iterable[str] = ()) -> Registry:
        """Add a project, or replace the one of the same name.

        Blank and built-in names are refused: the registry comes back unchanged.
        """
        project = CustomProject.of(name, aliases)
        if not project.name or project.name in PROJECT_NAMES:
            return self
        return Registry(self.remove(name).custom + (project,))

    def remove(self, name: str) -> Registry:
        gone = name.strip().upper()
        return Registry(tuple(p for p in self.custom if p.name != gone))

    # -- look-ups -----------------------------------------------------------

    def is_custom(self, name: str) -> bool:
        return any(p.name == name.strip().upper() for p in self.custom)

    def names(self) -> list[str]:
        """All target names: the curated ones, then the custom ones."""
        return list(dict.fromkeys(PROJECT_NAMES + [p.name for p in self.custom]))

    def names_df(self, spark: SparkSession) -> DataFrame:
        """``(ord, society)`` in registry order."""
        return spark.createDataFrame(list(enumerate(self.names())), "ord int, society string")

    def fingerprint(self) -> str:
        """Changes whenever the custom projects do; part of the parse-cache version."""
        return hashlib.sha256(repr(self.custom).encode()).hexdigest()[:16]

    # -- rules as columns ---------------------------------------------------

    def custom_names(self) -> list[tuple[str, str]]:
        """Names and aliases of the custom projects, with the project of each."""
        return [(n, p.name) for p in self.custom for n in (p.name, *p.aliases)]

    def canonical_in_text(self, c: Column) -> Column:
        """Registered project named anywhere in a text, else an empty string.

        Custom projects come before the built-in ones.
        """
        return first_filled(_first_named(c, self.custom_names()), _first_hit(c, TEXT_RULES))

    def canonical_plain(self, c: Column) -> Column:
        """Registered project of a name already through ``plain_letters``."""
        return let(normalise_plain(c), self._canonical_normalised)

    def canonical_name(self, c: Column) -> Column:
        """Registered project of a project or society name, else an empty string."""
        return self.canonical_plain(plain_letters(c))

    def is_selected_plain(self, c: Column) -> Column:
        return F.coalesce(self.canonical_plain(c) != "", F.lit(False))

    def is_selected(self, c: Column) -> Column:
        return F.coalesce(self.canonical_name(c) != "", F.lit(False))

    def _canonical_normalised(self, name: Column) -> Column:
        padded = F.concat(F.lit(" "), name, F.lit(" "))
        # the rules are one constant array: the plan does not grow with them
        rules = F.from_json(F.lit(json.dumps([{"project": p, "texts": t} for p, t in NAME_RULES])), "array<struct<project: string, texts: array<string>>>")
        hits = F.filter(rules, lambda rule: F.forall(rule["texts"], lambda text: F.contains(padded, text)))
        # one scan rejects the names that hold the first text of no rule
        known = quick(P.any_of(*[re.escape(texts[0]).replace("\\ ", " ") for _, texts in NAME_RULES]))
        # custom names are looked up at each letter
        own = looked_up(F.split(name, ""), [Phrase(i, tuple(spelling), spelling, project) for i, (project, spelling) in enumerate(self.name_spellings())],
                        lambda spelling: F.contains(name, spelling))["project"]
        return F.when(name == "", "").otherwise(F.coalesce(
            own, F.when(padded.rlike(known), F.get(hits, 0)["project"]), F.lit("")))

    def name_spellings(self) -> list[tuple[str, str]]:
        """Projects with what a normalised name of a custom one holds, in order."""
        return [(p.name, spelling) for p in self.custom
                for spelling in dict.fromkeys(_normalise_constant(n) for n in (p.name, *p.aliases)) if spelling]
