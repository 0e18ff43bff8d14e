"""One query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import dictionaries as D
from siftstone.functions import scalars as S
from siftstone.functions.text import before, column_after, found, line_after, once, pieces
from siftstone.llm.durable import written
from siftstone.operators import patterns as P
from siftstone.operators import runner, scan
from siftstone.sinks import render
from siftstone.sources.corpus import src_files, src_files_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL that several queries begin with -------------------------------------------------------------------------------
_EXT = " ".join(f"WHEN {q(e)} THEN {q(lang)}" for e, lang in D.EXTENSIONS.items())
_LANG = rf"CASE lower(regexp_extract(path, '\.([^.]*)$', 1)) {_EXT} END"
_FILES = f"files AS MATERIALIZED (SELECT *, strlen(content) AS size, {_LANG} AS language FROM ({src_files_sql()}))"
_LINES = """lines AS MATERIALIZED (SELECT *, COALESCE(lag(line_text) OVER (PARTITION BY path ORDER BY line), '') AS previous FROM (
  SELECT path, language, unnest(string_split(content, chr(10))) AS line_text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files))"""
_BASE = f"WITH {_FILES}, {_LINES}"
_CODE = "language IN ('javascript', 'typescript')"
_TRIM = r"regexp_replace(line_text, '^\s+|\s+$', '', 'g')"
_COMMENT = f"regexp_matches(line_text, {q(P.COMMENT_LINE)})"
_META = f"(regexp_matches({_TRIM}, {q(P.METADATA_LINE)}) OR regexp_matches({_TRIM}, {q(P.PATTERN_LINE)}))"
_DESC = "(" + " OR ".join(f"regexp_matches({_TRIM}, {q(r)})" for r in P.DESCRIPTION_LINE) + ")"
_EXCUSED = "(" + " OR ".join(f"contains(lower(line_text), {q(m)})" for m in P.EXCUSES) + f" OR contains(lower(previous), {q(P.NEXT)}))"
_SUPPRESSED = "(" + " OR ".join(f"contains(lower(line_text), {q(m)})" for m in (P.IGNORE, P.DISABLE)) + f" OR contains(lower(previous), {q(P.NEXT)}))"
_SKIPPED = f"regexp_matches(path, {q(P.SKIPPED_PATHS)})"


def _hit(regex: str, flags: str = "") -> tuple[str, str]:
    """Whether a line has a match, and at which column."""
    return f"regexp_matches(line_text, {q(flags + regex)})", f"length(regexp_extract(line_text, {q(f'{flags}^(.*?)(?:{regex})')}, 1)) + 1"


def _unsafe(p: P.Pattern) -> str:
    has, column = _hit(p.regex, "(?i)" if p.any_case else "")
    spared = "".join(f" AND NOT regexp_matches(line_text, {q(x)})" for x in p.excused) + (f" AND NOT regexp_matches(path, {q(P.SECRET_SKIPPED_PATHS)})" if p.secret else "")
    return f"SELECT path, {q(p.id)} AS id, line::INTEGER AS line, ({column})::INTEGER AS \"column\", line_text, previous, {q(p.message)} AS message, {p.confidence}::DOUBLE AS confidence, {q(p.cwe or '')} AS cwe, language FROM lines WHERE {has} AND NOT {_COMMENT} AND NOT {_META} AND NOT {_EXCUSED}{spared}"


_UNSAFE = f"unsafe AS MATERIALIZED ({' UNION ALL '.join(map(_unsafe, P.UNSAFE))})"
_BEFORE = 'substr(line_text, 1, "column" - 1)'
_IN_COMMENT = f"({_COMMENT} OR contains({_BEFORE}, '//') OR (contains({_BEFORE}, '/*') AND NOT contains({_BEFORE}, '*/')))"


def _global(p: P.Pattern) -> str:
    has, column = _hit(p.regex)
    return f"SELECT path, language, {q(p.id)} AS id, line, ({column})::INTEGER AS \"column\", line_text, previous FROM lines WHERE {has}"


_GLOBALS = f"globals AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(map(_global, P.PHANTOM))}) WHERE NOT {_IN_COMMENT} AND NOT {_DESC})"
_BIND_SQL = " UNION ALL ".join(
    f"SELECT path, regexp_extract(line_text, {q(r)}, 1) AS var, regexp_extract(line_text, {q(r)}, 2) AS module, {k} AS ord, line FROM lines WHERE regexp_matches(line_text, {q(r)})"
    for k, r in enumerate(p.format(s) for s in ("", "node:") for p in scan._BIND)
)
_BINDINGS = f"bindings AS MATERIALIZED (SELECT path, var, arg_max(module, ord * 1000000 + line) AS module FROM ({_BIND_SQL}) WHERE module IN ({', '.join(map(q, D.MODULES))}) GROUP BY path, var)"
_ACCESS = r"""accesses AS MATERIALIZED (SELECT path, language, line, line_text, previous, length(regexp_extract(line_text, '^(.*?)(?:\w+\.\w+\s*(?:\(|$))', 1)) + 1 AS "column",
  regexp_extract(line_text, '(\w+)\.(\w+)\s*(?:\(|$)', 1) AS var, regexp_extract(line_text, '(\w+)\.(\w+)\s*(?:\(|$)', 2) AS member FROM lines WHERE regexp_matches(line_text, '\w+\.\w+\s*(?:\(|$)'))"""
_MEMBERS = f"""members AS MATERIALIZED (SELECT a.*, b.module, h.replacement FROM accesses a JOIN bindings b USING (path, var)
  LEFT JOIN (VALUES {D.values('member_hints', 3)}) h(member, module, replacement) ON h.module = b.module AND h.member = a.member
  WHERE NOT EXISTS (SELECT 1 FROM (VALUES {D.values('module_exports', 2)}) e(member, module) WHERE e.module = b.module AND e.member = a.member) AND NOT {_IN_COMMENT} AND NOT {_DESC})"""
_IMPORT_KINDS = (
    ("import", r"import\s+(?:type\s+)?(?:(?:\{[^}]*\}|[*]\s+as\s+\w+|\w+)(?:\s*,\s*(?:\{[^}]*\}|[*]\s+as\s+\w+))?\s+from\s+)?['\"]([^'\"]+)['\"]"),
    ("export", r"export\s+(?:type\s+)?(?:\{[^}]*\}|[*](?:\s+as\s+\w+)?)\s+from\s+['\"]([^'\"]+)['\"]"),
    ("require", r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    ("dynamic", r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
)
_SPEC = r"""CASE WHEN id = 'dynamic' THEN '' WHEN id = 'export' THEN '*' WHEN contains(line_text, '{') THEN
    array_to_string(list_transform(string_split(regexp_extract(line_text, '\{([^}]*)\}', 1), ','), lambda x: regexp_replace(trim(x), '^.+?(?:\s+as\s+|:\s*)', '')), ',')
  ELSE concat(regexp_extract(line_text, 'import\s+(\w+)\s+from', 1), regexp_extract(line_text, 'as\s+(\w+)\s+from', 1), regexp_extract(line_text, 'const\s+(\w+)\s*=\s*require', 1)) END"""
_IMPORTS = "raw_imports AS (" + " UNION ALL ".join(
    f"SELECT path, language, line, line_text, previous, {q(k)} AS id, {o} AS ord, {_hit(r)[1]} AS \"column\", regexp_extract(line_text, {q(r)}, 1) AS source, regexp_extract(line_text, {q(r)}) AS raw FROM lines WHERE {_hit(r)[0]}" for o, (k, r) in enumerate(_IMPORT_KINDS)
) + rf"), imports AS MATERIALIZED (SELECT *, {_SPEC} AS specifiers, id = 'dynamic' AS is_dynamic, id IN ('import', 'export') AND regexp_matches(raw, '^(?:import|export)\s+type\s') AS is_type_only FROM raw_imports)"
_MERGED = """merged AS MATERIALIZED (SELECT path, language, source, is_dynamic, bool_and(is_type_only) AS is_type_only, arg_min(line, ord * 1000000 + line) AS line, arg_min("column", ord * 1000000 + line) AS "column", arg_min(raw, ord * 1000000 + line) AS raw,
  arg_min(line_text, ord * 1000000 + line) AS line_text, arg_min(previous, ord * 1000000 + line) AS previous,
  list_sort(list_distinct(list_filter(flatten(list(string_split(specifiers, ','))), lambda x: x <> ''))) AS specifiers FROM imports GROUP BY ALL)"""
_MERGED = _MERGED.replace("GROUP BY ALL", "GROUP BY path, language, source, is_dynamic")


def _bare(s: str) -> str:
    return f"(NOT starts_with({s}, '.') AND NOT starts_with({s}, '/') AND NOT contains({s}, ':'))"


def _package(s: str) -> str:
    return f"CASE WHEN {_bare(s)} THEN CASE WHEN starts_with({s}, '@') THEN CASE WHEN contains({s}, '/') THEN concat(split_part({s}, '/', 1), '/', split_part({s}, '/', 2)) END ELSE split_part({s}, '/', 1) END END"


_KNOWN = f"known AS MATERIALIZED (SELECT name, ord::INTEGER AS ord FROM (VALUES {D.values('known_packages', 2)}) k(name, ord)), builtin AS MATERIALIZED (SELECT unnest([name, 'node:' || name]) AS name FROM (VALUES {D.values('builtins', 1)}) b(name))"
_UNKNOWN = f"""unknown AS MATERIALIZED (SELECT * FROM (SELECT *, {_package('source')} AS package FROM merged WHERE NOT is_type_only) WHERE package IS NOT NULL AND NOT regexp_matches(source, '^(@/|~/|#)')
  AND package NOT IN (SELECT name FROM builtin) AND source NOT IN (SELECT name FROM builtin) AND package NOT IN (SELECT name FROM known))"""
_NEAREST = """nearest AS MATERIALIZED (SELECT package, arg_min(name, distance * 100000 + ord) AS closest, min(distance)::INTEGER AS distance FROM (
  SELECT u.package, k.name, k.ord, levenshtein(lower(u.package), lower(k.name)) AS distance FROM (SELECT DISTINCT package FROM unknown) u, known k) WHERE distance <= 3 GROUP BY package)"""
_PACKAGES = f"{_IMPORTS}, {_MERGED}, {_KNOWN}, {_UNKNOWN}, {_NEAREST}"
_FINDINGS = f"""findings AS MATERIALIZED (SELECT * FROM (
  SELECT 'sift/hallucinated-package' AS rule_id, 'error' AS severity, 'ai-specific' AS category, path AS file_path, line, "column", line_text, previous, distance IS NOT NULL AND distance <= 2 AS fixable, CASE WHEN closest IS NULL THEN 0.75 ELSE 0.9 END::DOUBLE AS confidence, language FROM unknown LEFT JOIN nearest USING (package)
  UNION ALL SELECT 'sift/phantom-api', 'warn', 'ai-specific', path, line, "column", line_text, previous, replacement IS NOT NULL, CASE WHEN replacement IS NULL THEN 0.8 ELSE 0.95 END, language FROM members
  UNION ALL SELECT 'sift/phantom-api', 'warn', 'ai-specific', path, line, "column", line_text, previous, false, 0.9, language FROM globals
  UNION ALL SELECT 'sift/unsafe-pattern', 'warn', 'security', path, line, "column", line_text, previous, false, confidence, language FROM unsafe)
  WHERE {_CODE} AND NOT regexp_matches(file_path, {q(P.SKIPPED_PATHS)}) AND NOT {_SUPPRESSED})"""
_ALL = f"{_BASE}, {_UNSAFE}, {_GLOBALS}, {_BINDINGS}, {_ACCESS}, {_MEMBERS}, {_PACKAGES}, {_FINDINGS}"
_FLAT = 'rule_id, severity, category, file_path, line::INTEGER AS line, "column"::INTEGER AS "column", fixable, confidence'


def _flat(df: DataFrame) -> DataFrame:
    return df.select("rule_id", "severity", "category", "file_path", "line", "column", F.col("fix").isNotNull().alias("fixable"), "confidence")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """All findings in the corpus of source files, flat."""
    return _flat(runner.run(src_files(spark, sf)))


# --- sources and scalars ------------------------------------------------------------------------------------------------
@query(f"WITH {_FILES} SELECT path, language, CASE WHEN language IN ('javascript', 'typescript') THEN 'swc' WHEN language IS NOT NULL THEN 'tree-sitter' END AS parser FROM files")
def detect_language(spark, sf):
    return src_files(spark, sf).select("path", "language", D.parser(F.col("language")).alias("parser"))


@query(f"WITH {_FILES} SELECT path, {_SKIPPED} AS skipped FROM files")
def skip_paths(spark, sf):
    return src_files(spark, sf).select("path", F.col("path").rlike(P.SKIPPED_PATHS).alias("skipped"))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents WHERE strlen(text) <= 1536")
def size_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))
    return docs.where(F.col("bytes") <= S.file_size(F.lit("1.5kb")))


@query("SELECT DISTINCT p_size, CASE p_size % 4 WHEN 0 THEN p_size * 512 WHEN 1 THEN (p_size * 1024) WHEN 2 THEN p_size::BIGINT * 1048576 END::BIGINT AS bytes FROM part")
def parse_file_size(spark, sf):
    n = F.col("p_size")
    text = F.when(n % 4 == 0, F.concat((n / 2).cast("decimal(10,1)").cast("string"), F.lit(" KB"))).when(n % 4 == 1, F.concat(n.cast("string"), F.lit("kb"))).when(n % 4 == 2, F.concat(n.cast("string"), F.lit("mb"))).otherwise("a lot")
    return table(spark, sf, "part").select("p_size", S.file_size(text).cast("bigint").alias("bytes")).distinct()


_SPECIFIERS = "CASE p_partkey % 6 WHEN 0 THEN concat('@', p_brand, '/', p_type) WHEN 1 THEN concat('./', p_type) WHEN 2 THEN concat('node:', p_brand) WHEN 3 THEN concat('@', p_brand) WHEN 4 THEN concat('@/', p_type) ELSE concat(p_brand, '/', p_type, '/x') END"


@query(f"SELECT p_partkey, s AS specifier, {_bare('s')} AS bare, {_package('s')} AS package, regexp_matches(s, '^(@/|~/|#)') AS alias FROM (SELECT p_partkey, {_SPECIFIERS} AS s FROM part)")
def package_name(spark, sf):
    s = F.col("specifier")
    return table(spark, sf, "part").select("p_partkey", F.expr(_SPECIFIERS).alias("specifier")).select("p_partkey", "specifier", S.is_bare(s).alias("bare"), S.package_name(s).alias("package"), S.is_path_alias(s).alias("alias"))


@query("SELECT p_partkey, concat('@', replace(replace(p_brand, '#', '%23'), ' ', '%20'), '%2F', replace(replace(p_type, '#', '%23'), ' ', '%20')) AS encoded FROM part")
def registry_path(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.registry_path(F.concat(F.lit("@"), "p_brand", F.lit("/"), "p_type")).alias("encoded"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT a.p_name AS a, b.p_name AS b, CASE WHEN greatest(length(a.p_name), length(b.p_name)) = 0 THEN 1.0 ELSE 1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) END::DOUBLE AS ratio FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey <= 60) a, (SELECT DISTINCT p_name FROM part WHERE p_partkey <= 60) b")
def similarity(spark, sf):
    names = table(spark, sf, "part").where("p_partkey <= 60").select("p_name").distinct()
    return names.select(F.col("p_name").alias("a")).crossJoin(names.select(F.col("p_name").alias("b"))).select("a", "b", S.similarity(F.col("a"), F.col("b")).alias("ratio"))


@query("SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 'error' WHEN 'view' THEN 'warn' WHEN 'signup' THEN 'info' ELSE 'error' END AS severity, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'signup' THEN 1 ELSE 3 END AS rank, CASE event_type WHEN 'view' THEN 'warning' WHEN 'signup' THEN 'note' ELSE 'error' END AS level FROM events")
def severities(spark, sf):
    name = F.when(F.col("event_type") == "click", "HIGH").when(F.col("event_type") == "view", "low").when(F.col("event_type") == "signup", "info").otherwise("what")
    rows = table(spark, sf, "events").select("event_type").distinct().withColumn("severity", S.severity_of(name))
    return rows.select("event_type", "severity", D.severity_rank(F.col("severity")).alias("rank"), S.sarif_level(F.col("severity")).alias("level"))


@query("SELECT event_id, floor(value * 100 + 0.5)::BIGINT AS percent FROM events")
def percent(spark, sf):
    return table(spark, sf, "events").select("event_id", S.percent(F.col("value")).cast("bigint").alias("percent"))


@query("SELECT p_partkey, CASE WHEN p_partkey < 1000 THEN concat(p_partkey, 'ms') ELSE printf('%.1fs', p_partkey / 1000.0) END AS took FROM part WHERE p_partkey % 100 <> 50")
def duration(spark, sf):
    return table(spark, sf, "part").where("p_partkey % 100 <> 50").select("p_partkey", S.duration(F.col("p_partkey")).alias("took"))


@query("SELECT DISTINCT p_name, list_aggregate(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', '+') AS names FROM part")
def rule_list(spark, sf):
    return table(spark, sf, "part").select("p_name", F.array_join(S.rule_list(F.replace("p_name", F.lit(" "), F.lit(" , "))), "+").alias("names")).distinct()


@query("SELECT event_id, unnest(json_keys(props)) AS name FROM events")
def json_keys(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("name"))


@query("SELECT doc_id, line::INTEGER AS line, regexp_replace(line_text, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS snippet FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)")
def line_snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "l")).select("doc_id", (F.col("k") + 1).cast("int").alias("line"), F.regexp_replace("l", r"^[ \t\r]+|[ \t\r]+$", "").alias("snippet"))


@query(r"SELECT doc_id, line::INTEGER AS line, (length(regexp_extract(l, '(?i)^(.*?)(?:(?:secret|token|bearer)\s*[:=])', 1)) + 1)::INTEGER AS column FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE regexp_matches(l, '(?i)(?:secret|token|bearer)\s*[:=]')")
def token_scan(spark, sf):
    regex = r"(?i)(?:secret|token|bearer)\s*[:=]"
    docs = table(spark, sf, "documents").select("doc_id", pieces(F.col("text"), regex).alias("parts"), F.posexplode(found(F.col("text"), regex)).alias("k", "m"))
    docs = once(docs, "doc_id", before=before(F.col("parts"), F.col("k"), F.col("m")))
    at = docs.select("doc_id", line_after(F.col("before")).alias("line"), column_after(F.col("before")).alias("column"))
    return at.groupBy("doc_id", "line").agg(F.min("column").alias("column"))


# --- imports and packages -----------------------------------------------------------------------------------------------
def _import_columns(df: DataFrame) -> DataFrame:
    return df.select("path", "source", F.array_join("specifiers", ",").alias("specifiers"), "is_dynamic", "is_type_only", "line", "column", "raw")


_IMPORT_SQL = f'{_BASE}, {_IMPORTS} SELECT path, source, specifiers, is_dynamic, is_type_only, line::INTEGER AS line, "column"::INTEGER AS "column", raw FROM imports'


@query(_IMPORT_SQL)
def imports_regex(spark, sf):
    return _import_columns(scan.imports(src_files(spark, sf), strategy="regex"))


@query(_IMPORT_SQL + " WHERE NOT is_type_only AND NOT is_dynamic")
def imports_masked_static(spark, sf):
    return _import_columns(scan.imports(src_files(spark, sf), types=False, dynamic=False))


@query(f'{_BASE}, {_IMPORTS}, {_MERGED} SELECT path, source, array_to_string(specifiers, \',\') AS specifiers, is_dynamic, is_type_only, line::INTEGER AS line, "column"::INTEGER AS "column" FROM merged')
def import_merge(spark, sf):
    merged = scan.merged_imports(src_files(spark, sf))
    return merged.select("path", "source", F.array_join(F.array_sort("specifiers"), ",").alias("specifiers"), "is_dynamic", "is_type_only", "line", "column")


@query(f"{_BASE}, {_IMPORTS} SELECT source, {_bare('source')} AS bare, count(*)::BIGINT AS n FROM imports GROUP BY ALL")
def partition_imports(spark, sf):
    return scan.imports(src_files(spark, sf)).groupBy("source", S.is_bare(F.col("source")).alias("bare")).agg(F.count("*").alias("n"))


@query(f"{_BASE}, {_IMPORTS}, {_MERGED} SELECT package, count(*)::BIGINT AS sites, count(DISTINCT path)::BIGINT AS files FROM (SELECT *, {_package('source')} AS package FROM merged) WHERE package IS NOT NULL GROUP BY package")
def package_sites(spark, sf):
    rows = scan.merged_imports(src_files(spark, sf), names=False).withColumn("package", S.package_name(F.col("source"))).where("package is not null")
    return rows.groupBy("package").agg(F.count("*").alias("sites"), F.countDistinct("path").alias("files"))


@query(f"{_BASE}, {_IMPORTS}, {_MERGED}, {_KNOWN}, {_UNKNOWN} SELECT path, source, package, line::INTEGER AS line FROM unknown")
def unknown_packages(spark, sf):
    return scan.unknown_packages(scan.merged_imports(src_files(spark, sf), names=False)).select("path", "source", "package", "line")


@query(f"{_BASE}, {_PACKAGES} SELECT * FROM nearest")
def nearest_package(spark, sf):
    rows = scan.unknown_packages(scan.merged_imports(src_files(spark, sf), names=False))
    return scan.nearest_packages(rows, D.known_packages(spark))


@query(f"WITH {_KNOWN} SELECT p AS package, name, levenshtein(p, name)::INTEGER AS distance, (1 - levenshtein(p, name)::DOUBLE / greatest(length(p), length(name))) AS similarity FROM (SELECT DISTINCT lower(left(split_part(p_name, ' ', 1), 5)) AS p FROM part), known WHERE levenshtein(p, name) BETWEEN 1 AND 2")
def typosquat(spark, sf):
    names = table(spark, sf, "part").select(F.lower(F.substring(F.split_part("p_name", F.lit(" "), F.lit(1)), 1, 5)).alias("package"))
    return scan.typosquats(names, D.known_packages(spark))


_MANIFESTS = "SELECT * FROM VALUES ('/project', '{{\"dependencies\":{{\"lodahs\":\"1\"}}}}'), ('/project/src/lib', '{{\"devDependencies\":{{\"expresss\":\"1\",\"left-padd\":\"2\"}}}}'), ('/project/src', 'not json') AS m(dir, content)"


def _manifests(spark):
    return spark.sql(_MANIFESTS.replace("{{", "{").replace("}}", "}"))


_DIR = "CASE WHEN starts_with(path, '/project/src/lib/') THEN '/project/src/lib' ELSE '/project' END"


@query(f"WITH {_FILES} SELECT path, {_DIR} AS dir FROM files")
def nearest_manifest(spark, sf):
    return scan.nearest_manifest(src_files(spark, sf).select("path"), _manifests(spark)).select("path", "dir")


@query(f"{_BASE}, {_IMPORTS}, {_MERGED}, {_KNOWN}, {_UNKNOWN} SELECT path, package, line::INTEGER AS line FROM unknown WHERE (({_DIR}), package) NOT IN (('/project', 'lodahs'), ('/project/src/lib', 'expresss'), ('/project/src/lib', 'left-padd'))")
def undeclared_packages(spark, sf):
    files = src_files(spark, sf)
    return scan.unknown_packages(scan.merged_imports(files, names=False), _manifests(spark), files).select("path", "package", "line")


@query("SELECT * FROM (VALUES ('/project', 'lodahs'), ('/project/src/lib', 'expresss'), ('/project/src/lib', 'left-padd')) m(dir, name)")
def manifest_dependencies(spark, sf):
    return scan.manifest_dependencies(_manifests(spark))


@query(f"{_BASE}, {_IMPORTS}, {_MERGED} SELECT path, source, line::INTEGER AS line FROM (SELECT *, {_package('source')} AS package FROM merged) WHERE package IN ('lodahs', 'expresss')")
def registry_missing(spark, sf):
    registry = spark.createDataFrame([("lodahs", False), ("react", True), ("expresss", False), ("left-padd", False)], "name string, exists boolean")
    declared = spark.createDataFrame([("left-padd",)], "name string")
    return scan.registry_missing(scan.merged_imports(src_files(spark, sf), names=False), registry, declared).select("path", "source", "line")


@query(f"WITH {_KNOWN} SELECT DISTINCT x AS name, CASE WHEN starts_with(x, '.') OR starts_with(x, '/') THEN true ELSE x IN (SELECT name FROM builtin) END AS \"exists\", CASE WHEN starts_with(x, '.') OR starts_with(x, '/') OR x IN (SELECT name FROM builtin) THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT unnest(['fs', './a', '/b', 'react', 'node:path', lower(p_brand)]) AS x FROM part)")
def verify_package(spark, sf):
    names = table(spark, sf, "part").select(F.explode(F.array(*[F.lit(x) for x in ("fs", "./a", "/b", "react", "node:path")], F.lower("p_brand"))).alias("name")).distinct()
    known = F.broadcast(D.builtins(spark).withColumn("own", F.lit(True)))
    there = F.col("name").rlike("^[./]") | F.coalesce("own", F.lit(False))
    return names.join(known, "name", "left").select("name", there.alias("exists"), F.when(there, 1.0).otherwise(0.0).alias("confidence"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey % 7 = 0)")
def bloom_member(spark, sf):
    part = table(spark, sf, "part")
    return part.join(part.where("p_partkey % 7 = 0").select("p_name"), "p_name", "left_semi").select("p_partkey", "p_name")


# --- modules and patterns -----------------------------------------------------------------------------------------------
@query(f"{_BASE}, {_BINDINGS} SELECT path, var, module FROM bindings")
def module_bindings(spark, sf):
    return scan.module_bindings(src_files(spark, sf)).select("path", "var", "module")


@query(f'{_BASE}, {_ACCESS} SELECT path, var, member, line::INTEGER AS line, "column"::INTEGER AS "column" FROM accesses WHERE NOT contains(line_text, \'xs.\')')
def member_accesses(spark, sf):
    return scan.member_accesses(src_files(spark, sf)).where("not contains(line_text, 'xs.')").select("path", "var", "member", "line", "column")


@query(f'{_BASE}, {_BINDINGS}, {_ACCESS}, {_MEMBERS} SELECT path, var, module, member, replacement, line::INTEGER AS line, "column"::INTEGER AS "column" FROM members')
def phantom_members(spark, sf):
    return scan.phantom_members(src_files(spark, sf)).select("path", "var", "module", "member", "replacement", "line", "column")


@query(f"{_BASE}, {_GLOBALS} SELECT path, id, line::INTEGER AS line, \"column\" FROM globals")
def phantom_globals(spark, sf):
    return scan.phantom_globals(src_files(spark, sf)).select("path", "id", "line", "column")


@query(f'{_BASE}, {_UNSAFE} SELECT path, id, line, "column", {_TRIM} AS snippet, message, confidence, cwe FROM unsafe')
def unsafe_scan(spark, sf):
    f = scan.unsafe_findings(src_files(spark, sf))
    return f.select(F.col("file_path").alias("path"), F.col("meta.pattern_id").alias("id"), "line", "column", F.col("code_snippet").alias("snippet"), "message", "confidence", F.col("meta.cwe_id").alias("cwe"))


def _pattern_query(p: P.Pattern):
    def one(spark, sf):
        return scan.unsafe_matches(src_files(spark, sf), (p,)).select("path", "line", "column")

    query(f'{_BASE}, u AS ({_unsafe(p)}) SELECT path, line, "column" FROM u', "unsafe_" + p.id.replace("-", "_"))(one)


for _p in P.UNSAFE:
    _pattern_query(_p)


@query(f"{_BASE} SELECT path, line::INTEGER AS line, {_COMMENT} AS comment, {_META} AS metadata, {_DESC} AS description, {_EXCUSED} AS excused, {_SUPPRESSED} AS suppressed FROM lines")
def line_filters(spark, sf):
    lines = src_files(spark, sf).select("path", F.split("content", "\n", -1).alias("ls")).select("path", "ls", F.posexplode("ls").alias("k", "l"))
    before = F.when(F.col("k") > 0, F.get("ls", F.col("k") - 1)).otherwise("")
    x = F.col("l")
    return lines.select("path", (F.col("k") + 1).cast("int").alias("line"), scan.is_comment(x).alias("comment"), scan.is_metadata(x).alias("metadata"), scan.is_description(x).alias("description"), scan.excused(x, before).alias("excused"), scan.suppressed(x, before).alias("suppressed"))


# --- rules, runner, totals ----------------------------------------------------------------------------------------------
query(f"{_ALL} SELECT {_FLAT} FROM findings", "findings_union")(flagship)


def _rule_query(name: str, rule: str):
    def one(spark, sf):
        return _flat(runner.run(src_files(spark, sf), runner.Settings(only=(rule,))))

    query(f"{_ALL} SELECT {_FLAT} FROM findings WHERE rule_id = {q(rule)}", name)(one)


for _n, _r in (("rule_hallucinated_package", "sift/hallucinated-package"), ("rule_phantom_api", "sift/phantom-api"), ("rule_unsafe_pattern", "sift/unsafe-pattern")):
    _rule_query(_n, _r)


#: What is shown of a finding, and what it is ordered by.
ORDERED = ("rule_id", "severity", "category", "file_path", "line", "column", "fix", "confidence", "rule_ord", "part", "ord", "begin")


@query(f"{_ALL} SELECT {_FLAT}, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END)::INTEGER * 0 + CASE severity WHEN 'error' THEN 3 ELSE 2 END AS rank FROM findings")
def findings_sorted(spark, sf):
    # the sort reads its rows twice, first for the borders of its parts: they are found once
    return _flat(runner.ordered(written(runner.run(src_files(spark, sf)).select(*ORDERED), "findings"))).withColumn("rank", D.severity_rank(F.col("severity")))


@query(f"{_ALL} SELECT {_FLAT.replace('severity', 'new_severity AS severity', 1)} FROM (SELECT *, CASE rule_id WHEN 'sift/phantom-api' THEN 'info' ELSE severity END AS new_severity FROM findings WHERE rule_id <> 'sift/unsafe-pattern')")
def severity_override(spark, sf):
    over = spark.createDataFrame([("sift/phantom-api", "info"), ("sift/unsafe-pattern", "off")], "rule_id string, severity string")
    return _flat(runner.overridden(runner.run(src_files(spark, sf)), over))


@query(f"{_ALL} SELECT {_FLAT} FROM findings WHERE category <> 'security' AND rule_id <> 'sift/hallucinated-package'")
def rule_enablement(spark, sf):
    return _flat(runner.run(src_files(spark, sf), runner.Settings(categories={"security": False}, rules={"sift/hallucinated-package": "off"})))


@query(f"{_ALL} SELECT {_FLAT} FROM findings WHERE severity = 'error'")
def severity_threshold(spark, sf):
    return _flat(runner.run(src_files(spark, sf), runner.Settings(threshold="error")))


@query(f"{_ALL} SELECT {_FLAT} FROM findings WHERE file_path NOT LIKE '%.tsx'")
def rule_languages(spark, sf):
    return _flat(runner.run(src_files(spark, sf).where("path not like '%.tsx'")))


_SUMMARY = "count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (fixable) AS fixable, count(*) FILTER (category = 'ai-specific') AS ai_specific, count(*) FILTER (category = 'security') AS security, count(*) FILTER (category = 'correctness') AS correctness"


@query(f"{_ALL} SELECT {_SUMMARY} FROM findings")
def summary(spark, sf):
    return runner.summary(runner.run(src_files(spark, sf)))


@query(f"{_ALL} SELECT CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 1 ELSE 0 END::INTEGER AS exit_code FROM findings")
def exit_code(spark, sf):
    return runner.exit_code(runner.summary(runner.run(src_files(spark, sf))))


@query(f"WITH {_FILES} SELECT count(*) AS files, count(*) FILTER ({_CODE} AND NOT {_SKIPPED}) AS parsed, count(*) FILTER ({_SKIPPED}) AS skipped, 0::BIGINT AS cached FROM files")
def metrics(spark, sf):
    return runner.metrics(src_files(spark, sf))


@query(f"{_ALL} SELECT rule_id, count(*)::BIGINT AS n, min(file_path) AS first_path, CASE min(severity) WHEN 'error' THEN 'error' ELSE 'warning' END AS level FROM findings GROUP BY rule_id")
def sarif_rules(spark, sf):
    f = runner.run(src_files(spark, sf))
    return f.groupBy("rule_id").agg(F.count("*").alias("n"), F.min("file_path").alias("first_path"), S.sarif_level(F.min("severity")).alias("level"))


@query(f"{_ALL} SELECT file_path, severity, count(*)::BIGINT AS n, min(line)::INTEGER AS first_line FROM findings GROUP BY ALL")
def findings_by_file(spark, sf):
    return runner.run(src_files(spark, sf)).groupBy("file_path", "severity").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query()
def render_json(spark, sf):
    return render.pieces(runner.run(src_files(spark, sf)), "json")


@query()
def render_sarif(spark, sf):
    return render.pieces(runner.run(src_files(spark, sf)), "sarif")


@query()
def render_pretty(spark, sf):
    return render.pieces(runner.run(src_files(spark, sf)), "pretty")


@query(f"WITH {_FILES} SELECT 'team/big-file' AS rule_id, path AS file_path, 1::INTEGER AS line, 'Over 250 bytes.' AS message FROM files WHERE {_CODE} AND NOT {_SKIPPED} AND size > 250")
def custom_rule(spark, sf):
    def find(files):
        rows = files.where("size > 250").select("path", F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit(0).alias("ord"), F.lit(0).alias("begin"), F.lit("").alias("text"), F.lit("").alias("line_text"))
        return scan.finding(rows, "x", "Big file", "info", "correctness", 9, message=F.lit("Over 250 bytes."), confidence=F.lit(1.0))

    registry = runner.Registry(())
    registry.register(runner.Rule("team/big-file", "correctness", "info", find))
    return runner.run(src_files(spark, sf), registry=registry).select("rule_id", "file_path", "line", "message")
