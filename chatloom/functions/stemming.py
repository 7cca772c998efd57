"""Porter's stemming algorithm (Program 14, 1980) as column expressions over lower-case words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions.columns import let

_C = "[^aeiou][^aeiouy]*"  # consonant run
_V = "[aeiouy][aeiou]*"  # vowel run
_M0 = f"^(?:{_C})?{_V}{_C}"  # measure above 0
_M1 = f"^(?:{_C})?{_V}{_C}{_V}{_C}"  # measure above 1
_EQ1 = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"  # measure 1
_HAS_VOWEL = f"^(?:{_C})?[aeiouy]"
_SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"  # consonant-vowel-consonant

# Suffixes and what replaces them.
_STEP2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize"
    " ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
)
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "ement ment al ance ence er ic able ible ant ent ou ism ate iti ous ive ize"


def _ends(w: Column, *suffixes: str) -> Column:
    """Cheap test that the word is longer than a suffix it ends with; most words fail it at once."""
    tests = [w.endswith(x) & (F.length(w) > len(x)) for x in suffixes]
    return reduce(lambda a, b: a | b, tests)


def _without(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(suffix))


def _choose(w: Column, cases) -> Column:
    """The first case whose suffix fits decides, even if its own condition then leaves the word alone."""
    expr = None
    for test, value in cases:
        expr = F.when(test, value) if expr is None else expr.when(test, value)
    return expr.otherwise(w)


def _step1a(w: Column) -> Column:
    plural = F.when(_ends(w, "sses", "ies"), _without(w, "es")).when(w.endswith("ss"), w).otherwise(_without(w, "s"))
    return F.when(_ends(w, "s"), plural).otherwise(w)


def _tail_fixed(stem: Column) -> Column:
    return (
        F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(stem.rlike(r"([^aeiouylsz])\1$"), _without(stem, "x"))
        .when(stem.rlike(_SHORT), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )


def _step1b(w: Column) -> Column:
    cases = [(_ends(w, "eed"), F.when(_without(w, "eed").rlike(_M0), _without(w, "d")).otherwise(w))]
    for suffix in ("ed", "ing"):
        stem = _without(w, suffix)
        cases.append((_ends(w, suffix), F.when(stem.rlike(_HAS_VOWEL), let(stem, _tail_fixed)).otherwise(w)))
    return _choose(w, cases)


def _step1c(w: Column) -> Column:
    stem = _without(w, "y")
    return F.when(_ends(w, "y") & stem.rlike(_HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)


def _suffixes(rules: str):
    def step(w: Column) -> Column:
        cases = []
        for rule in sorted(rules.split(), key=lambda r: -len(r.split(":")[0])):
            suffix, new = rule.split(":")
            stem = _without(w, suffix)
            cases.append((_ends(w, suffix), F.when(stem.rlike(_M0), F.concat(stem, F.lit(new))).otherwise(w)))
        return _choose(w, cases)

    return step


def _step4(w: Column) -> Column:
    cases = []
    for suffix in sorted(_STEP4.split(), key=len, reverse=True):
        stem = _without(w, suffix)
        cases.append((_ends(w, suffix), F.when(stem.rlike(_M1), stem).otherwise(w)))
    stem = _without(w, "ion")
    cases.append((_ends(w, "sion", "tion"), F.when(stem.rlike(_M1), stem).otherwise(w)))
    return _choose(w, cases)


def _step5(w: Column) -> Column:
    stem = _without(w, "e")
    drops = stem.rlike(_M1) | (stem.rlike(_EQ1) & ~stem.rlike(_SHORT))
    return F.when(_ends(w, "e") & drops, stem).otherwise(w)


def _step5b(w: Column) -> Column:
    return F.when(_ends(w, "ll") & w.rlike(_M1), _without(w, "l")).otherwise(w)


def porter_stems(tokens: Column) -> Column:
    """Stems of an array of lower-case words; words of one or two letters stay. A leading y is a consonant."""

    def apply(step, words: Column) -> Column:
        return F.transform(words, lambda w: F.when(F.length(w) < 3, w).otherwise(step(w)))

    stems = F.transform(tokens, lambda w: F.regexp_replace(w, "^y", "Y"))
    for step in (_step1a, _step1b, _step1c, _suffixes(_STEP2), _suffixes(_STEP3), _step4, _step5, _step5b):
        stems = apply(step, stems)
    return F.transform(stems, lambda w: F.regexp_replace(w, "^Y", "y"))
