"""Text expressions: Python-like rendering, whitespace, cleaning, tokenisers, n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STREAM_SAFE_WS = r"(?U)\s+"  # (?U): Unicode spaces count as whitespace


def normalize_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, STREAM_SAFE_WS, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def _float_text(c: Column) -> Column:
    """Positional notation for 1e-4 <= |x| < 1e16 and e-notation with a two-digit exponent elsewhere."""
    s = c.cast("string")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    lead = F.regexp_extract(s, r"^-?(\d)\.(\d+)E(-?\d+)$", 1)
    frac = F.regexp_replace(F.regexp_extract(s, r"^-?(\d)\.(\d+)E(-?\d+)$", 2), r"^0$", "")
    exp = F.regexp_extract(s, r"E(-?\d+)$", 1).cast("int")
    digits = F.concat(lead, frac)
    shifted = F.when(
        F.length(frac) <= exp, F.concat(digits, F.repeat(F.lit("0"), exp - F.length(frac)), F.lit(".0"))
    ).otherwise(F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    power = F.concat(
        F.when(frac == "", lead).otherwise(F.concat(lead, F.lit("."), frac)),
        F.when(exp < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exp).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exp).cast("string"))), F.lit("0")),
    )
    scientific = F.concat(
        sign, F.when((exp >= 0) & (exp < 16), shifted).when((exp < 0) & (exp >= -4), small).otherwise(power)
    )
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(s.isin("Infinity", "-Infinity"), F.regexp_replace(s, "Infinity", "inf"))
        .when(s.contains("E"), scientific)
        .otherwise(s)
    )


def py_text(c: Column, dtype: T.DataType, null_text: str = "") -> Column:
    """The text a value takes in a template or a message; a null becomes ``null_text``."""
    if isinstance(dtype, T.StringType):
        text = c
    elif isinstance(dtype, T.BooleanType):
        text = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = _float_text(c)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        text = F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(
            F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        )
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(null_text))


def clean_chars(c: Column) -> Column:
    """Lower-case letters and single spaces only; apostrophes vanish, every other sign becomes a space."""
    plain = F.replace(F.replace(c, F.lit("’"), F.lit("")), F.lit("'"), F.lit(""))
    return F.ltrim(F.regexp_replace(F.lower(plain), "[^a-z]+", " "))


def words(c: Column) -> Column:
    """Non-empty space-separated words."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def tokens_13a(c: Column) -> Column:
    """The mteval-13a tokenisation used for corpus BLEU."""
    t = F.replace(F.replace(F.replace(c, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([ \p{Punct}&&[^',.\-]])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(t, STREAM_SAFE_WS), lambda w: w != "")


def tokens_rouge(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def tokens_words(c: Column) -> Column:
    """Lower-cased words and single punctuation signs."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+|[^\w\s])"), 1)


def ngrams(tokens: Column, n: int) -> Column:
    """Every run of n tokens, joined by a space. Tokens are read by position: slicing would copy the whole array
    for every n-gram."""
    if n == 1:
        return tokens
    return F.when(
        F.size(tokens) >= n,
        F.transform(
            F.sequence(F.lit(0), F.size(tokens) - n),
            lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)]),
        ),
    ).otherwise(F.array().cast("array<string>"))
