"""Small column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity weights of a hotspot score; an unknown severity weighs 1, a missing one counts as medium.
SEVERITY_WEIGHT = {"critical": 10, "high": 5, "medium": 2, "low": 1}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ladder(cases: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for condition, value in reversed(cases):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def severity_weight(severity: str | Column) -> Column:
    s = F.coalesce(col(severity), F.lit("medium"))
    return ladder([(s == k, w) for k, w in SEVERITY_WEIGHT.items()], 1)


def first_keyword(text: Column, keywords: Mapping[str, str], otherwise: str) -> Column:
    """The value of the first keyword, in their order, that the text contains."""
    return ladder([(F.contains(text, F.lit(k)), v) for k, v in keywords.items()], otherwise)


def basename(path: str | Column) -> Column:
    return F.substring_index(col(path), "/", -1)


def under_path(path: Column, root: str) -> Column:
    """Whether a path lies in the subtree ``root``: contains it, contains ``/name/`` or starts with ``name/``."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    name = root.rstrip("/").rsplit("/", 1)[-1]
    return F.contains(plain, F.lit(root)) | F.contains(plain, F.lit(f"/{name}/")) | F.startswith(plain, F.lit(f"{name}/"))


def clipped(text: Column, n: int, mark: str = "...") -> Column:
    """The first ``n`` characters, with a mark only if something is cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def domain_of_path(path: str | Column, keywords: Mapping[str, str], otherwise: str, reach: int = 3) -> Column:
    """The value of the first keyword in a path's last ``reach`` parts, read from the right without extension, ``_`` and ``-``."""
    parts = F.slice(F.reverse(F.split(F.lower(col(path)), "/")), 1, reach)
    clean = lambda p: F.regexp_replace(F.regexp_replace(p, r"\.php$", ""), "[_-]", "")
    found = F.filter(F.transform(parts, lambda p: ladder([(F.contains(clean(p), F.lit(k)), v) for k, v in keywords.items()])), lambda v: v.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(otherwise))
