"""Which rules run where, and what becomes of their findings."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.dictionaries import severity_rank
from siftstone.operators import patterns as P
from siftstone.operators import scan

CATEGORIES = ("ai-specific", "security", "correctness")


@dataclass(frozen=True)
class Rule:
    """``find`` makes findings of files; languages limit which files it gets. ``heeds``: it leaves suppressed lines out by itself."""

    id: str
    category: str
    severity: str
    find: Callable[[DataFrame], DataFrame]
    languages: tuple[str, ...] = ("javascript", "typescript")
    fixable: bool = False
    heeds: bool = False


@dataclass(frozen=True)
class Settings:
    rules: Mapping[str, str] = field(default_factory=dict)  # severity by rule id
    categories: Mapping[str, bool] = field(default_factory=dict)
    only: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    threshold: str = "info"
    fail_on: str = "error"
    max_warnings: int = -1
    scan_tests: bool = False


BUILTIN = (
    Rule(f"{scan.PREFIX}/hallucinated-package", "ai-specific", "error", scan.package_findings, fixable=True, heeds=True),
    Rule(f"{scan.PREFIX}/phantom-api", "ai-specific", "warn", scan.phantom_findings, fixable=True, heeds=True),
    Rule(f"{scan.PREFIX}/unsafe-pattern", "security", "warn", scan.unsafe_findings, heeds=True),
)


class Registry:
    """Rules by id; an id is taken once."""

    def __init__(self, rules: tuple[Rule, ...] = BUILTIN) -> None:
        self.rules: dict[str, Rule] = {}
        for r in rules:
            self.register(r)

    def register(self, rule: Rule) -> None:
        if rule.id in self.rules:
            raise ValueError(f"there is a rule {rule.id} already")
        self.rules[rule.id] = rule

    def add_plugins(self, rules: tuple[Rule, ...]) -> None:
        """Adds those whose ids aren't taken."""
        for r in rules:
            self.rules.setdefault(r.id, r)

    def for_language(self, language: str) -> list[Rule]:
        return [r for r in self.rules.values() if language in r.languages]

    def enabled(self, settings: Settings) -> list[Rule]:
        on = lambda r: settings.categories.get(r.category, True) and settings.rules.get(r.id, r.severity) != "off"
        return [r for r in self.rules.values() if on(r) and r.id not in settings.exclude and (not settings.only or r.id in settings.only)]


def without_skipped(files: DataFrame) -> DataFrame:
    return files.where(~F.col("path").rlike(P.SKIPPED_PATHS))


def suppressed_lines(files: DataFrame) -> DataFrame:
    """``(file_path, line)`` that comments suppress: few rows, whatever the files' size."""
    marked = files.where(F.lower("content").contains(P.IGNORE) | F.lower("content").contains(P.DISABLE))
    lines = marked.select(F.col("path").alias("file_path"), F.posexplode(F.split(F.lower("content"), "\n", -1)).alias("k", "text"))
    k = F.col("k")
    hit = lines.where(F.col("text").contains(P.IGNORE) | F.col("text").contains(P.DISABLE))
    return hit.select("file_path", F.explode(F.when(F.col("text").contains(P.NEXT), F.array(k + 1, k + 2)).otherwise(F.array(k + 1))).alias("line")).distinct()


def inline_filtered(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings but those whose line, or the one before, suppresses them; contents aren't moved."""
    return findings.join(suppressed_lines(files), ["file_path", "line"], "left_anti").select(*findings.columns)


def overridden(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Severities as ``overrides(rule_id, severity)`` say; ``off`` drops a rule's findings."""
    o = overrides.select("rule_id", F.col("severity").alias("_own"))
    return findings.join(F.broadcast(o), "rule_id", "left").withColumn("severity", F.coalesce("_own", "severity")).where("severity <> 'off'").drop("_own").select(*findings.columns)


def meets(severity: Column, threshold: str) -> Column:
    return severity_rank(severity) >= severity_rank(F.lit(threshold))


def run(files: DataFrame, settings: Settings = Settings(), registry: Registry | None = None) -> DataFrame:
    """All findings of the enabled rules in ``files(path, content, size, language)``."""
    seen = files if settings.scan_tests else without_skipped(files)
    out = files.sparkSession.createDataFrame([], scan.FINDING)
    for rule in (registry or Registry()).enabled(settings):
        found = rule.find(seen.where(F.col("language").isin(*rule.languages)))
        stamped = found.withColumn("rule_id", F.lit(rule.id)).withColumn("category", F.lit(rule.category)).withColumn("severity", F.lit(settings.rules.get(rule.id, rule.severity)))
        # lines are there when a finding is made: only rules that don't heed comments need the files again
        out = out.unionByName(stamped if rule.heeds else inline_filtered(stamped, seen))
    return out.where(meets(F.col("severity"), settings.threshold))


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, worst first, then path, rule, and place."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), F.collate(F.col("file_path"), "UNICODE"), "file_path", "rule_ord", "part", "ord", "begin")


def summary(findings: DataFrame) -> DataFrame:
    """One row: findings by severity, those with a fix, and by category."""
    count = lambda c: F.count_if(c).alias
    cols = [count(F.col("severity") == s)(n) for s, n in (("error", "errors"), ("warn", "warnings"), ("info", "info"))]
    return findings.agg(*cols, count(F.col("fix").isNotNull())("fixable"), *[count(F.col("category") == c)(c.replace("-", "_")) for c in CATEGORIES])


def exit_code(totals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(exit_code)`` of a row of :func:`summary`."""
    e, w, i = F.col("errors") > 0, F.col("warnings") > 0, F.col("info") > 0
    fails = {"error": e, "warn": e | w, "info": e | w | i}.get(settings.fail_on, F.lit(False))
    return totals.select(F.when(fails | (F.lit(settings.max_warnings >= 0) & (F.col("warnings") > settings.max_warnings)), 1).otherwise(0).alias("exit_code"))


def metrics(files: DataFrame) -> DataFrame:
    """One row of ``files``, ``parsed`` (in a language with rules), ``skipped`` by path."""
    skip = F.col("path").rlike(P.SKIPPED_PATHS)
    return files.agg(F.count("*").alias("files"), F.count_if(F.col("language").isin("javascript", "typescript") & ~skip).alias("parsed"), F.count_if(skip).alias("skipped"), F.lit(0).cast("bigint").alias("cached"))
