"""Identifier cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 10_000)))


def pascal(name: Column) -> Column:
    """Words at ``_``, ``-`` and spaces capitalised, their tails in lower case."""
    return F.array_join(F.transform(F.split(name, "[_\\- ]+"), _capital), "")


def camel(name: Column) -> Column:
    p = pascal(name)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 10_000))


def kebab_plain(name: Column) -> Column:
    """A hyphen before every capital but the first, underscores as hyphens."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "([A-Z])", "-$1"), "_", "-"), "^-", ""))


def _acronyms(name: Column, joint: str) -> Column:
    out = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", f"$1{joint}$2")
    return F.regexp_replace(out, "([a-z0-9])([A-Z])", f"$1{joint}$2")


def kebab(name: Column) -> Column:
    """Acronyms stay together: HTTPServer is http-server."""
    return F.lower(F.regexp_replace(_acronyms(name, "-"), "[_ ]+", "-"))


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(_acronyms(name, "_"), "[\\- ]+", "_"))


def message_pattern(service: Column, class_name: Column, method: Column) -> Column:
    """``service.class_part.method_part`` in dotted lower case; a Service or Controller ending goes."""
    part = F.regexp_replace(class_name, "(Service|Controller|Manager)$", "")
    return F.concat_ws(".", F.lower(service), snake(part), snake(method))
