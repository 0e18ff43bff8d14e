"""What is known about packages, modules, languages and severities, as small tables."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA = Path(__file__).parent / "data"


@lru_cache
def _rows(name: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(line.split("\t")) for line in (_DATA / f"{name}.tsv").read_text().splitlines())


def known_packages(spark: SparkSession) -> DataFrame:
    """``(ord, name)``: packages that exist; of equally near names the least ``ord`` wins."""
    return spark.createDataFrame([(int(k), n) for n, k in _rows("known_packages")], "ord int, name string")


def builtins(spark: SparkSession) -> DataFrame:
    """``(name)`` of the runtime's own modules, without and with their scheme."""
    return spark.createDataFrame([(x,) for (n,) in _rows("builtins") for x in (n, f"node:{n}")], "name string")


def module_exports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, x) for x, m in _rows("module_exports")], "module string, member string")


def member_hints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, k, v) for k, m, v in _rows("member_hints")], "module string, member string, replacement string")


def values(name: str, columns: int) -> str:
    """The dictionary as a SQL list of values."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(q(x) for x in row[:columns]) + ")" for row in _rows(name))


MODULES = sorted({m for _, m in _rows("module_exports")})

LANGUAGES = {
    "javascript": ("cjs", "js", "jsx", "mjs"), "typescript": ("cts", "mts", "ts", "tsx"), "python": ("py", "pyw"),
    "go": ("go",), "rust": ("rs",), "java": ("java",), "ruby": ("rb",),
}
EXTENSIONS = {e: lang for lang, es in LANGUAGES.items() for e in es}
SEVERITIES = {"off": 0, "info": 1, "warn": 2, "error": 3}


def _of(mapping: dict[str, object], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def language(path: Column, any_case: bool = True) -> Column:
    """Language by what follows the last dot; null if unknown."""
    ext = F.regexp_extract(path, r"\.([^.]*)$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.lower(ext) if any_case else ext)


def parser(lang: Column) -> Column:
    return F.when(lang.isin("javascript", "typescript"), "swc").when(lang.isNotNull(), "tree-sitter")


def severity_rank(severity: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), severity)
