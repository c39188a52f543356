"""Which commands are not worth logging."""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.functions.text import WHITESPACE, trim_ws

# Commands dropped when they stand alone, and first words
# dropped with any arguments.
NOISE_EXACT = ["ls", "pwd", "history", "clear", "exit"]
NOISE_WORDS = ["cd", "ls"]


@dataclass(frozen=True)
class NoiseRules:
    """``self_names`` are the names under which the logger itself is called."""

    ignore_exact: list[str] = field(default_factory=list)
    ignore_prefix: list[str] = field(default_factory=list)
    use_builtin: bool = True
    self_names: list[str] = field(default_factory=list)


def _any(texts: list[str]) -> str:
    return "(?:" + "|".join(map(re.escape, texts)) + ")"


def _matches(cmd: Column, patterns: list[str]) -> Column:
    """Does the trimmed command match one of the patterns from its start on?

    One trim and one pattern, whatever the number of rules: a chain of
    comparisons would grow past what the JVM compiles.
    """
    return trim_ws(cmd).rlike("^(?:" + "|".join(patterns) + ")")


def _builtin(self_names: list[str]) -> list[str]:
    words = NOISE_WORDS + list(self_names)
    return [_any(NOISE_EXACT) + r"\z", _any(words) + r"(?:[ \t]|\z)"]


def _exact(rules: list[str]) -> list[str]:
    return [_any([r.strip(WHITESPACE) for r in rules]) + r"\z"] if rules else []


def _prefix(rules: list[str]) -> list[str]:
    return [_any(rules)] if rules else []


def is_blank(cmd: Column) -> Column:
    return trim_ws(cmd) == ""


def is_builtin_noise(cmd: Column, self_names: list[str] | None = None) -> Column:
    return _matches(cmd, _builtin(self_names or []))


def is_ignored_exact(cmd: Column, rules: list[str]) -> Column:
    """Both sides are compared without surrounding white space."""
    return _matches(cmd, _exact(rules)) if rules else F.lit(False)


def is_ignored_prefix(cmd: Column, rules: list[str]) -> Column:
    """Rules are taken as written; an empty one matches every command."""
    return _matches(cmd, _prefix(rules)) if rules else F.lit(False)


def is_noise(cmd: Column, rules: NoiseRules | None = None) -> Column:
    rules = rules or NoiseRules()
    builtin = _builtin(rules.self_names) if rules.use_builtin else []
    blank = [r"\z"]
    return _matches(cmd, blank + builtin + _exact(rules.ignore_exact) + _prefix(rules.ignore_prefix))


def drop_noise(df: DataFrame, rules: NoiseRules | None = None) -> DataFrame:
    return df.where(~is_noise(F.col("cmd"), rules))
