"""``str.format`` templates compiled once on the driver into a single concat expression."""

from __future__ import annotations

import re
import string
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPEC = re.compile(r"(?:(?P<fill>.)?(?P<align>[<>^]))?(?P<zero>0)?(?P<width>\d+)?(?:\.(?P<precision>\d+))?s?", re.S)


class TemplateFailure(ValueError):
    """The template cannot be rendered for any row: an unknown field, a stray brace or a non-text format."""


def _formatted(value: Column, spec: str) -> Column:
    if not spec:
        return value
    m = _SPEC.fullmatch(spec)
    if m is None:
        raise TemplateFailure(f"format {spec!r} does not apply to text")
    if m["precision"]:
        value = F.substring(value, 1, int(m["precision"]))
    if not m["width"]:
        return value
    width, fill = int(m["width"]), F.lit(m["fill"] or ("0" if m["zero"] else " "))
    gap = F.greatest(F.lit(width) - F.length(value), F.lit(0))
    left = {"<": F.lit(0), ">": gap, "^": F.floor(gap / 2).cast("int")}[m["align"] or "<"]
    return F.concat(F.repeat(fill, left), value, F.repeat(fill, gap - left))


def compile_template(template: str, fields: Mapping[str, Column]) -> Column:
    """``fields`` holds the text expression of every source column; only the fields named are read."""
    try:
        pieces = list(string.Formatter().parse(template))
    except ValueError as e:
        raise TemplateFailure(str(e)) from e
    out: list[Column] = []
    for literal, name, spec, conversion in pieces:
        if literal:
            out.append(F.lit(literal))
        if name is None:
            continue
        if name == "" or name.isdigit() or re.search(r"[.\[]", name):
            raise ValueError(f"template field {{{name}}} must be a plain column name")
        if conversion not in (None, "s") or "{" in (spec or ""):
            raise ValueError(f"unsupported conversion or nested format in template field {{{name}}}")
        if name not in fields:
            raise TemplateFailure(f"unknown template field {name!r}")
        out.append(_formatted(fields[name], spec or ""))
    return F.concat(*out) if out else F.lit("")
