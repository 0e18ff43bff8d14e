"""Results as text: JSON, SARIF 2.1.0, for terminals.

:func:`result` collects findings for one text in memory; :func:`pieces` is the same
document as a table of its pieces, of any size: nothing is collected.
"""

from __future__ import annotations

import datetime
import json
import os
import sys
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.durable import discard, written
from siftstone.operators.runner import CATEGORIES, Settings, exit_code, ordered, summary

VERSION = "0.1.0"
LEVELS = {"error": "error", "warn": "warning"}


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.title() for x in rest)


def _number(x: Any) -> Any:
    return int(x) if isinstance(x, float) and x == int(x) else x


def result(findings: DataFrame, settings: Settings = Settings(), scanned: dict[str, int] | None = None, timestamp: str | None = None, languages: tuple[str, ...] = ("typescript", "javascript")) -> dict[str, Any]:
    """The whole result as plain values, findings in their order."""
    rows = [_plain(r.asDict(recursive=True)) for r in ordered(findings).drop(*PLACES).toLocalIterator()]
    return _result(findings, rows, settings, scanned, timestamp, languages)


PLACES = ("rule_ord", "part", "ord", "begin")


def _plain(d: dict[str, Any]) -> dict[str, Any]:
    d["meta"] = {_camel(k): v for k, v in (d["meta"] or {}).items() if v is not None}
    return {_camel(k): _number(v) for k, v in d.items() if v is not None or k in ("fix", "suggestion", "owasp_ref")}


def _result(findings: DataFrame, rows: list[Any], settings: Settings, scanned: dict[str, int] | None, timestamp: str | None, languages: tuple[str, ...]) -> dict[str, Any]:
    totals = summary(findings)
    counts, code = totals.first().asDict(), exit_code(totals, settings).first()[0]
    return {
        "version": VERSION, "timestamp": timestamp or datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"),
        "config": {"failOn": settings.fail_on, "rules": len(settings.rules), "languages": list(languages)}, "scan": scanned or {}, "findings": rows,
        "summary": {k: counts[k] for k in ("errors", "warnings", "info", "fixable")} | {"categories": {c: counts[c.replace("-", "_")] for c in CATEGORIES}}, "exitCode": code,
    }


def as_json(res: dict[str, Any]) -> str:
    return json.dumps(res, indent=2, ensure_ascii=False)


def _sarif_rule(f: dict[str, Any]) -> dict[str, Any]:
    return {"id": f["ruleId"], "shortDescription": {"text": f["message"]}, "defaultConfiguration": {"level": LEVELS.get(f["severity"], "note")}, "properties": {"category": f["category"]}}


def _sarif_row(f: dict[str, Any]) -> dict[str, Any]:
    region = {"startLine": f["line"], "startColumn": f["column"], "endLine": f["endLine"], "endColumn": f["endColumn"], "snippet": {"text": f["codeSnippet"]}}
    place = {"artifactLocation": {"uri": f["filePath"]}, "region": region}
    row: dict[str, Any] = {"ruleId": f["ruleId"], "level": LEVELS.get(f["severity"], "note"), "message": {"text": f["message"]}, "locations": [{"physicalLocation": place}]}
    if f["fix"]:
        spot = {k: v for k, v in region.items() if k != "snippet"}
        row["fixes"] = [{"description": {"text": f.get("suggestedFix", "")}, "artifactChanges": [{"artifactLocation": place["artifactLocation"], "replacements": [{"deletedRegion": spot, "insertedContent": {"text": f["fix"]["to"]}}]}]}]
    if f["confidence"] < 1:
        row["properties"] = {"confidence": f["confidence"]}
    return row


def _sarif(res: dict[str, Any], rules: list[Any], results: list[Any], tool: str) -> str:
    run = {"tool": {"driver": {"name": tool, "version": res["version"], "rules": rules}}, "results": results, "invocations": [{"executionSuccessful": res["exitCode"] != 3}]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False)


def as_sarif(res: dict[str, Any], tool: str = "siftstone") -> str:
    rules: dict[str, dict[str, Any]] = {}
    for f in res["findings"]:
        rules.setdefault(f["ruleId"], _sarif_rule(f))
    return _sarif(res, list(rules.values()), [_sarif_row(f) for f in res["findings"]], tool)


def _sure(f: dict[str, Any]) -> str:
    return f" ({int(f['confidence'] * 100 + 0.5)}%)" if f["confidence"] < 1 else ""


TITLES = {"error": "Errors", "warn": "Warnings", "info": "Info"}


def _pretty_row(f: dict[str, Any], k: int) -> list[str]:
    hint = f"fix: {f['fix']['from']} -> {f['fix']['to']}" if f["fix"] else f.get("suggestion")
    return [f"{k:>4}. {f['filePath']}:{f['line']}:{f['column']} {f['message']}{_sure(f)}", *([f"      {hint}"] if hint else [])]


def _pretty_ends(res: dict[str, Any], count: int) -> tuple[str, list[str]]:
    s = res["summary"]
    return f"{count} findings in {res['scan'].get('files', 0)} files", ["", f"{s['errors']} errors, {s['warnings']} warnings, {s['info']} info, {s['fixable']} fixable"]


def as_pretty(res: dict[str, Any]) -> str:
    """Numbered findings, the worst first."""
    head, last = _pretty_ends(res, len(res["findings"]))
    out, k = [head], 0
    for severity, title in TITLES.items():
        own = [f for f in res["findings"] if f["severity"] == severity]
        if own:
            out += ["", f"{title} ({len(own)})"]
        for f in own:
            k += 1
            out += _pretty_row(f, k)
    return "\n".join([*out, *last])


def numbered(findings: DataFrame) -> DataFrame:
    """``findings`` in their order with their numbers ``k`` from 1, as a table in the shared folder: found once, sorted once, numbered by the counts of the sorted parts."""
    stored = findings if hasattr(findings, "written_path") else written(findings, "findings")
    rows = written(ordered(stored).drop(*PLACES).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, most = F.shiftright("_at", 33), (1 << 33) - 1
    counts = sorted(map(tuple, rows.groupBy(part.alias("part")).count().collect()))  # a row for each part
    behind = [sum(n for _, n in counts[:i]) for i in range(len(counts))]
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, behind)], "part bigint, behind bigint")
    return rows.join(F.broadcast(offsets), part == offsets["part"]).withColumn("k", F.col("_at").bitwiseAND(F.lit(most)) + F.col("behind") + 1).drop("_at", "part", "behind")


_HERE = "findings are here"


def pieces(findings: DataFrame, form: str, settings: Settings = Settings(), scanned: dict[str, int] | None = None, timestamp: str | None = None, languages: tuple[str, ...] = ("typescript", "javascript"), tool: str = "siftstone") -> DataFrame:
    """``(piece, document)``: what ``json``, ``sarif`` or ``pretty`` is of :func:`result`, a row for what is before the findings, for each of them, and for what is behind them.

    The document is the pieces in their order, with line ends between. Rows are in
    that order already; ``piece`` counts from 0.
    """
    spark = findings.sparkSession
    stored = written(findings, "findings")
    res = _result(stored, [], settings, scanned, timestamp, languages)
    rows = numbered(stored)
    discard(stored)
    count, pad, firsts = rows.count(), "", {}
    if form == "pretty":
        head, last = _pretty_ends(res, count)
        foot = "\n".join(last)
        of = dict(zip(TITLES, ("errors", "warnings", "info")))
        first, sums = 1, res["summary"]
        for severity, title in TITLES.items():
            if own := sums[of[severity]]:
                firsts[first] = f"\n{title} ({own})\n"
            first += own
        rows, count = rows.where(F.col("severity").isin(*TITLES)), first - 1
    else:
        here = [_HERE] if count else []
        if form == "json":
            text = as_json(res | {"findings": here})
        else:
            each = rows.groupBy("rule_id").agg(F.min_by(F.struct("rule_id", "message", "severity", "category", "k"), "k").alias("f")).select("f.*").collect()  # a row for each rule
            text = _sarif(res, [_sarif_rule({"ruleId": f.rule_id, **f.asDict()}) for f in sorted(each, key=lambda f: f.k)], here, tool)
        if not count:
            return spark.createDataFrame([(0, text)], "piece bigint, document string")
        head, foot = text.rsplit(f'"{_HERE}"', 1)
        pad = head[head.rindex("\n") + 1 :]
        head, foot = head[: head.rindex("\n")], foot[1:]

    def told(f: dict[str, Any], k: int) -> str:
        if form == "pretty":
            return firsts.get(k, "") + "\n".join(_pretty_row(f, k))
        text = json.dumps(f if form == "json" else _sarif_row(f), indent=2, ensure_ascii=False)
        return pad + text.replace("\n", "\n" + pad) + ("," if k < count else "")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                rows = whole.slice(start, 2000).to_pylist()
                numbers = [d.pop("k") for d in rows]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([told(_plain(d), k) for d, k in zip(rows, numbers)], pa.string())], ["piece", "document"])

    kind = "piece bigint, document string"
    one = lambda k, text: spark.createDataFrame([(k, text)], kind).coalesce(1)
    return one(0, head).union(rows.orderBy("k").mapInArrow(write, kind)).union(one(count + 1, foot))


def as_text(res: dict[str, Any]) -> str:
    """By file, each finding with its line and a mark under what was found."""
    by: dict[str, list[dict[str, Any]]] = {}
    for f in res["findings"]:
        by.setdefault(f["filePath"], []).append(f)
    out = []
    for path, own in by.items():
        out.append(path)
        for f in sorted(own, key=lambda f: (f["line"], f["column"])):
            out += [f"  {f['line']}:{f['column']} {f['severity']} {f['message']} {f['ruleId']}", f"    {f['codeSnippet']}", "    " + "^" * max(1, min(60, f["endColumn"] - f["column"], len(f["codeSnippet"])))]
            hint = f.get("suggestedFix") or f.get("suggestion") or (f["fix"] or {}).get("to")
            out += [f"    {hint}"] if hint else []
    return "\n".join(out)


FORMATS: dict[str, Callable[[dict[str, Any]], str]] = {"json": as_json, "sarif": as_sarif, "pretty": as_pretty, "text": as_text}


class Output:
    """Formats by name; own ones come before those that are there."""

    def __init__(self) -> None:
        self.own: dict[str, Callable[[dict[str, Any]], str]] = {}

    def register(self, name: str, form: Callable[[dict[str, Any]], str]) -> None:
        self.own[name] = form

    def format(self, res: dict[str, Any], name: str) -> str:
        form = self.own.get(name) or FORMATS.get(name)
        if form is None:
            raise ValueError(f"no format {name}; there are {', '.join(sorted({*FORMATS, *self.own}))}")
        return form(res)

    def write(self, res: dict[str, Any], name: str, path: str | None = None) -> None:
        text = self.format(res, name)
        if path is None:
            sys.stdout.write(text + "\n")
        else:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)


def detected_format(terminal: bool | None = None, environment: dict[str, str] | None = None) -> str:
    terminal = sys.stdout.isatty() if terminal is None else terminal
    return "pretty" if terminal and not (os.environ if environment is None else environment).get("CI") else "json"
