"""Source files as a table; and a corpus of them made from the ``events`` table, by SQL that other engines run as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.dictionaries import language


#: A line or two of source for each kind; {k} is the event's number.
_LINES = (
    "import React from ''react'';", "import {{ parse as p, build }} from ''expresss'';", "import * as fs from ''node:fs'';", "const path = require(''path'');", "import ''./local/{k}'';",
    "import type {{ T }} from ''unknown-types-{k}'';", "import lodahs from ''lodahs'';", "export * from ''@scope/pkg-{k}/sub'';", "const {{ a: b, c }} = require(''left-padd'');", "import(''lazy-module-{k}'');",
    "eval(input{k});", "  el.innerHTML = v{k};", "const f = new Function(''return {k}'');", "// eval(commented{k})", "eval(x); // nosec", "const q = \"SELECT * FROM t WHERE id = \" + id{k};",
    "const apiKey = ''abcdef12345{k}'';", "const api_key = ''example-key-{k}'';", "const password = ''hunter2{k}'';", "agent({{ rejectUnauthorized: false }});", "fs.readFilePromise(''x{k}'');", "fs.readFileSync(''x'');",
    "path.combine(a, b);", "JSON.tryParse(s{k});", "xs.flatDeep(); Math.clamp(v, 0, {k});", "// fs.deleteFile(''no'')", "message: ''eval(told)'',", "// sift-disable-next-line", "eval(y); // sift-ignore", "let n{k} = {k};",
)


_PATH = """concat('/project/', CASE event_id % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/lib/' ELSE 'src/' END, 'f', CAST(event_id AS STRING),
  CASE event_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '.tsx' ELSE '.py' END) AS path"""
_AT = f"CAST((event_id * (7 + 4 * k) + user_id * (3 + k) + 5 * k) % {len(_LINES)} AS INT) + 1"


def _texts(quote: str) -> str:
    return ", ".join("'" + t.format(k="%").replace("''", quote) + "'" for t in _LINES)


def src_files_sql() -> str:
    """The corpus in DuckDB's SQL: a file for every event, twelve lines each."""
    lines = f"array_to_string(list_transform(range(10), lambda k: ([{_texts(chr(39) * 2)}])[{_AT}]), chr(10))"
    return f"SELECT {_PATH}, concat('/* file */', chr(10), replace({lines}, '%', CAST(event_id % 97 AS STRING)), chr(10), '// ', event_type) AS content FROM events".replace("AS STRING", "AS VARCHAR")


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content, size, language)``."""
    lines = f"array_join(transform(sequence(0, 9), k -> element_at(array({_texts(chr(92) + chr(39))}), {_AT})), chr(10))"
    content = f"concat('/* file */', chr(10), replace({lines}, '%', CAST(event_id % 97 AS STRING)), chr(10), '// ', event_type) AS content"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")  # slim rows; contents are made behind it
    # a generated row is made once, however many patterns look at its content
    return with_language(events.selectExpr(f"inline(array(struct({_PATH}, {content})))"))


def with_language(files: DataFrame) -> DataFrame:
    """``files(path, content)`` with their bytes and language."""
    return files.select("path", "content", F.octet_length("content").cast("bigint").alias("size"), language(F.col("path")).alias("language"))
