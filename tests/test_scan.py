import re

import pytest
from pyspark.sql import functions as F

from siftstone.functions.text import dialect, masked
from siftstone.operators import patterns as P
from siftstone.operators import runner, scan
from siftstone.plans import catalogue

SF = "/root/testdata/sf0.001"

TEXTS = {
    "/p/a.ts": "eval(x)\n  eval (y); eval\n(z) xeval(1) 😀 eval(2)\n",
    "/p/b.ts": "/* from */ import a from 'aa'; const s = \"from 'no'\"; // import 'never'\nimport type {T} from 'tt'\nimport {x as y} from 'tt'; import\n'bb'\r\n`import 'q' ${1}` + don't\nimport \"cc\" 'é' /* open",
    "/p/c.ts": "import fs from 'fs'\nconst path = require('path')\nfs.nope(1); ufs.nope(2)\n  fs.nope\n\n(3) path.combine(a)\nfs.readFileSync(x)\n",
    "/p/d.ts": "",
    "/p/e.ts": "eval(x) // sift-ignore\n// sift-disable-next-line\nimport 'lodahs'\nimport 'lodahs'\nimport 'expresss'; JSON.tryParse(1)\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, t, len(t.encode()), "typescript") for p, t in TEXTS.items()], "path string, content string, size bigint, language string")


def at(text, begin):
    return text.count("\n", 0, begin) + 1, begin - (text.rfind("\n", 0, begin) + 1) + 1


def test_every_match_has_its_place(files):
    got = {tuple(r) for r in scan.located(files, [("x", dialect(r"\beval\s*\("), 7, ("eval",))]).select("path", "id", "ord", "begin", "text", "line", "column").collect()}
    assert got == {(p, "x", 7, m.start(), m[0], *at(t, m.start())) for p, t in TEXTS.items() for m in re.finditer(r"\beval\s*\(", t)}


def test_masking_keeps_places_and_specifiers(spark):
    token = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|`(?:\\[\s\S]|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")

    def want(text):
        out, last = "", 0
        for m in token.finditer(text):
            gap = text[last : m.start()]
            keep = m[0][0] in "'\"" and re.search(r"(?s)(?:\bfrom|\bimport|\brequire\s*\(|\bimport\s*\()\s*\Z", gap)
            out, last = out + gap + (m[0] if keep else re.sub(r"[^\n]", " ", m[0])), m.end()
        return out + text[last:]

    texts = [*TEXTS.values(), "a / b from 'x' // from 'y'\n/from 'z'", "`" + "x" * 20_000 + "` '" + "y\\'" * 5000 + "'", "require ( \"r\" ) 'import' 'i' \"open\nfrom 'k'"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", masked(F.col("t"))).collect()
    assert dict(map(tuple, rows)) == {k: want(t) for k, t in enumerate(texts)}


def test_statements_and_bindings_meet_in_their_file(files):
    merged = {(r.path, r.source): (r.line, r.is_type_only, r.previous.strip()[:6]) for r in scan.merged_imports(files, names=False).collect()}
    assert merged[("/p/b.ts", "tt")] == (2, False, "/* fro") and merged[("/p/b.ts", "bb")][0] == 3 and ("/p/b.ts", "never") not in merged and ("/p/b.ts", "no") not in merged
    assert {tuple(r) for r in scan.merged_imports(files).select("path", "source", F.array_join("specifiers", ","), "line").where("path = '/p/b.ts' and source = 'tt'").collect()} == {("/p/b.ts", "tt", "T,y", 2)}
    assert {tuple(r) for r in scan.phantom_members(files).select("module", "member", "line", "column").collect()} == {("fs", "nope", 3, 1), ("fs", "nope", 4, 3), ("path", "combine", 6, 5)}


def test_suppressed_lines_have_no_findings(files):
    got = sorted((r.rule_id, r.line) for r in runner.run(files).where("file_path = '/p/e.ts'").collect())
    assert got == [("sift/hallucinated-package", 5), ("sift/phantom-api", 5)]


@pytest.mark.parametrize("p", [*P.UNSAFE, *P.PHANTOM], ids=lambda p: p.id)
def test_what_a_pattern_needs_is_in_each_alternative(p):
    """Without any of the parts of one need, the pattern can't match: they cover a group's alternatives, or are in what all have."""
    plain = re.sub(r"\\s[*+]|\\b|\[_-\]\?", " ", p.regex).replace("\\", "")
    fold = str.lower if p.any_case else str
    for need in p.needs:
        if "|" in need:
            assert any(all(any(fold(n) in fold(alternative) for n in need.split("|")) for alternative in group.split("|")) for group in [plain, *re.findall(r"\(\?:([^()]*)\)", plain)])
        else:
            assert all(fold(need) in fold(x) for x in (plain.split("|") if "|" in plain and "(?:" not in plain and "[" not in plain else [plain]))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["unsafe_hardcoded_token", "findings_union", "unknown_packages", "phantom_members"])
def test_contents_and_findings_are_not_moved(spark, name):
    """Only slim events, and the few distinct names of packages, are shuffled."""
    moved = [x for x in re.findall(r"Exchange hashpartitioning\(([^,)]*)", plan(catalogue.QUERIES[name](spark, SF)))]
    assert {x.split("#")[0] for x in moved} <= {"event_id", "package", "length"}
    assert not re.search(r"SortMergeJoin \[(?:path|file_path)", plan(catalogue.QUERIES[name](spark, SF)))


def test_sorted_findings_are_found_once(spark):
    """What is sorted is read from a table of findings: no pattern is looked for in the plan."""
    df = catalogue.QUERIES["findings_sorted"](spark, SF)
    assert "regexp_extract_all" not in plan(df)
    rows = df.select("rank").collect()
    assert [r.rank for r in rows] == sorted((r.rank for r in rows), reverse=True)
