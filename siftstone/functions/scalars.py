"""Scalar functions on specifiers, sizes, severities and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"b": 0, "kb": 10, "mb": 20, "gb": 30}
THRESHOLDS = {"critical": "error", "high": "error", "medium": "warn", "low": "warn", "info": "info"}


def is_bare(specifier: Column) -> Column:
    return ~specifier.startswith(".") & ~specifier.startswith("/") & ~specifier.contains(":")


def package_name(specifier: Column) -> Column:
    """``@scope/name`` or the part before the first slash; null for paths, schemes and lone scopes."""
    scoped = F.when(specifier.contains("/"), F.substring_index(specifier, "/", 2))
    return F.when(is_bare(specifier), F.when(specifier.startswith("@"), scoped).otherwise(F.substring_index(specifier, "/", 1)))


def is_path_alias(specifier: Column) -> Column:
    return specifier.rlike("^(@/|~/|#)")


def similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.try_divide(F.levenshtein(a, b).cast("double"), most.cast("double")))


def file_size(text: Column) -> Column:
    """Bytes of ``1.5mb`` and the like, rounded down; null for what isn't a size."""
    form = r"(?i)^(\d+(?:\.\d+)?)\s*(gb|mb|kb|b)$"
    t = F.trim(text)
    scale = F.element_at(F.create_map(*[F.lit(x) for k, p in UNITS.items() for x in (k, 2**p)]), F.lower(F.regexp_extract(t, form, 2)))
    return F.when(t.rlike(form), F.floor(F.regexp_extract(t, form, 1).cast("double") * scale))


def severity_of(threshold: Column) -> Column:
    """The severity of a threshold's name; ``error`` for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv]), F.lower(threshold)), F.lit("error"))


def rule_list(text: Column) -> Column:
    """Names between commas; null if there is none."""
    names = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(names) > 0, names)


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "error", "error").when(severity == "warn", "warning").otherwise("note")


def percent(confidence: Column) -> Column:
    return F.floor(confidence * 100 + 0.5)


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / F.lit(1000.0)))


def registry_path(name: Column) -> Column:
    """A package name in a registry's address: the scope's slash and all that isn't safe are escaped."""
    enc = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.when(name.startswith("@"), F.concat(F.lit("@"), enc(F.substring(name, 2, 1 << 30)))).otherwise(enc(name))
