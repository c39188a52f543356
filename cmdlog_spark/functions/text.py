"""Text helpers. All stay inside code generation except the word pattern."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def trim_ws(text: Column) -> Column:
    """Strip white space of any kind; Spark's ``trim`` alone strips only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def rtrim_ws(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only. ``lower`` would also fold letters beyond ASCII."""
    return F.translate(text, UPPER, LOWER)


def ascii_lower_str(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"(?U)^\s*(\S+)", 1)


def truncate(text: Column, width: int) -> Column:
    """Cut to ``width`` characters, the last three of them dots."""
    if width <= 3:
        short = F.lit("...")
    else:
        short = F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    return F.when(F.length(text) > width, short).otherwise(text)


def suggestion_text(text: Column) -> Column:
    return truncate(text, 60)


def escape_like(text: str, escape: str = "\\") -> str:
    """Make ``text`` literal inside a ``LIKE`` pattern written by hand."""
    for char in (escape, "%", "_"):
        text = text.replace(char, escape + char)
    return text


def parse_long(text: Column) -> Column:
    """Strict signed 64-bit parse: no blanks, no suffix, null on overflow."""
    return F.regexp_extract(text, r"^([+-]?[0-9]+)\z", 1).try_cast("bigint")


def json_text(text: Column) -> Column:
    """``text`` as a JSON string literal."""
    whole = F.to_json(F.struct(text.alias("t")))
    return F.when(text.isNull(), "null").otherwise(
        whole.substr(F.lit(6), F.length(whole) - 6)
    )


def variation_mark(cmd: Column, base: Column | str) -> Column:
    """Empty for the base command, an arrow when arguments follow, else unequal."""
    base = F.lit(base) if isinstance(base, str) else base
    return (
        F.when(cmd == base, "")
        .when(cmd.startswith(F.concat(base, F.lit(" "))), "→")
        .otherwise("≠")
    )
