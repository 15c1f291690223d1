"""Sorted alternations are found where the plain ones are."""

from pyspark.sql import functions as F

import brickledger as b
from brickledger.functions import patterns as P
from brickledger.functions.projects import NAME_RULES, SPELLINGS, TEXT_RULES
from brickledger.functions.scans import alternatives, quick

TEXTS = ["", "x", "plot", "plots", "aplot", "SCO 12", "sect 5", "ſco plot", "Kunj", "Kunj Delhi", "dlf phase 3 golf  course road", "park\nview",
         "3 bhk + SQ", "1200 sq ft @ 9500", "rent 45k p.m", "M3M  Capital Walk", "Smart World one DXP", "ats Triumph", "if you have an option",
         "İndustrial it space", "office-commercial", "İcon ıcon", "contact: Asha Verma 9000012345", "2.5 cr all incl maint", "+ m", "a/month"]
EVERY = [v for k, v in vars(P).items() if k.isupper() and isinstance(v, str) and "{}" not in v] + [p for p, _ in P.PROPERTY_TYPES] + [
    P.any_of(P.BHK, P.SIZE, P.CRORE, P.LISTING_BODY), P.any_of(P.CRORE, P.LAKH, P.THOUSAND, P.PLAIN_AMOUNT),
    P.any_of(*[p for p, _ in TEXT_RULES]), *[p for p, _ in TEXT_RULES], P.any_of(*[p for p, _ in SPELLINGS])]
PATTERNS = [p for p in EVERY if quick(p) != p]  # the others stay as they are


def words_of(pattern):
    """Some texts for a pattern: its own letters, with and without the marks between them."""
    plain = "".join(ch if ch.isalnum() or ch in " |" else " " for ch in pattern.replace(r"\b", "").replace(r"\s", " "))
    return [part.strip() for part in plain.split("|") if part.strip()][:40]


def test_sorted_alternations_are_found_in_the_same_texts(spark):
    texts = sorted({form for t in TEXTS + [w for p in PATTERNS for w in words_of(p)]
                    for form in (t, t.upper(), f"({t.lower()})", f"a{t}", f"{t}s 5")})
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    text = F.col("text")
    for flags in ("(?iu)", ""):
        differ = df.select("text", *[
            (text.rlike(flags + p) != text.rlike(flags + quick(p))).alias(f"p{i}") for i, p in enumerate(PATTERNS)])
        wrong = differ.agg(*[F.max_by("text", f"p{i}").alias(f"t{i}") for i in range(len(PATTERNS))],
                           *[F.max(f"p{i}").alias(f"p{i}") for i in range(len(PATTERNS))]).first()
        assert [(PATTERNS[i], wrong[f"t{i}"]) for i in range(len(PATTERNS)) if wrong[f"p{i}"]] == []


def test_a_long_alternation_is_entered_by_its_first_letter():
    sorted_hints = quick(P.PROJECT_HINTS)
    assert len(alternatives(P.PROJECT_HINTS)) > 100
    assert sorted_hints.startswith("(?=[")
    assert len(PATTERNS) > 20
    assert quick(r"\bsco\b") == r"(?=[s])\bsco\b"


def test_first_text_of_every_name_rule_passes_the_scan_of_names(spark):
    names = spark.createDataFrame([(" ".join(t.strip() for t in texts), project) for project, texts in NAME_RULES], "name string, project string")
    found = names.select("name", b.Registry().canonical_name(F.col("name")).alias("found")).filter("found = ''")
    assert found.collect() == []
