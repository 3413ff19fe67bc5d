"""Globs and topic filters as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}])")


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def glob_regex_column(pattern: Column) -> Column:
    """Permission globs as regular expressions: * is any run of characters; nothing else is special."""
    escaped = F.regexp_replace(pattern, r"([\\.^$|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("$"))


def topic_regex(filter_: str) -> str:
    """A topic filter: + is one level, a last # the rest and its parent; a leading wildcard doesn't match topics that begin with $."""
    levels = filter_.split("/")
    guard = r"(?!\$)" if levels[0] in ("+", "#") else ""
    if levels[-1] == "#":
        head = "/".join("[^/]*" if x == "+" else escape(x) for x in levels[:-1])
        return f"^{guard}.*$" if not levels[:-1] else f"^{guard}{head}(/.*)?$"
    return f"^{guard}" + "/".join("[^/]*" if x == "+" else escape(x) for x in levels) + "$"


def best_match(topic: Column, filters: list[tuple[str, int]]) -> Column:
    """The highest service level of the filters that match a topic; null if none does."""
    return F.array_max(F.array(*(F.when(topic.rlike(topic_regex(f)), F.lit(q)) for f, q in filters)))


def topic_fault(topic: Column) -> Column:
    """Why a topic name isn't valid; null if it is."""
    return (
        F.when(F.coalesce(topic, F.lit("")) == "", "empty")
        .when(F.octet_length(topic) > 65535, "too long")
        .when(topic.rlike("[+#]"), "wildcard")
        .when(F.instr(topic, "\0") > 0, "nul")
    )
