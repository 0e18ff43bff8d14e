"""Operator 4: line-first cleaning.

Every line of a document is judged on its own, by rules of punctuation,
navigation and boilerplate; lines that fail one are removed. Then a document
that has lost too much of its text is rejected. All rules are expressions of
the engine, one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line ends with one of these marks, closing quotes and brackets after it.
TERMINAL = ".!?…:;。！？；：।؟۔"
CLOSING = "\"'”’»)]}」』"
#: Largest share of marks and symbols among a line's visible characters.
MOST_MARKS = 0.15
#: Marks between the items of a menu, and how many a navigation line has, at least and by word.
SEPARATORS, LEAST_SEPARATORS, SEPARATOR_SHARE = "|>»›•·→", 2, 0.15
#: What pages put around their text. A line is boilerplate if it has one and no more words than BOILERPLATE_WORDS.
BOILERPLATE = r"(?i)all rights reserved|copyright|©|privacy policy|terms of (use|service)|cookies?\b|javascript|lorem ipsum|\blicen[cs]ed under\b|\bsubscribe\b|\bsign (in|up)\b|\blog ?in\b"
BOILERPLATE_WORDS = 40
#: Largest share of a document's text that its removed lines may have.
MOST_LOST = 0.5

_BREAK, _SPACE = r"\r\n|\n|\r", " \t\u000b\f 　"


def _in_class(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-[" else c for c in chars)


def line_passes(line: Column) -> Column:
    """Whether a trimmed line is neither unpunctuated, nor of marks, nor navigation, nor boilerplate."""
    visible = F.length(F.regexp_replace(line, r"\s+", ""))
    marks = F.length(F.regexp_replace(line, r"[\p{L}\p{M}\p{N}\s]+", ""))
    separators = F.length(line) - F.length(F.translate(line, SEPARATORS, ""))
    words = F.size(F.split(line, r"\s+"))
    punctuated = line.rlike(f"[{_in_class(TERMINAL)}][{_in_class(CLOSING)}]*$") & (marks <= visible * MOST_MARKS)
    navigation = (separators >= LEAST_SEPARATORS) & (separators >= words * SEPARATOR_SHARE)
    boilerplate = (words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return punctuated & ~navigation & ~boilerplate


def cleaned(docs: DataFrame, *, most_lost: float = MOST_LOST) -> DataFrame:
    """``(doc_id, text, n_lines, n_kept, kept_share)`` of the documents that stay, their text without the lines that failed.

    Lines end at any line break and are trimmed; those without a visible
    character don't count. A line that repeats an earlier kept one of its
    document is boilerplate too: the first stays. ``kept_share`` is what of the
    characters of all lines is left; a document stays with ``1 - most_lost`` or
    more (ties stay) and at least one line. Null and empty texts are rejected.
    Whole texts are read, in time proportional to their length. Repeated rows
    give equal rows, null ids are kept as they are, other columns may have any
    name, an empty table gives no rows.
    """
    lines = F.filter(F.transform(F.split(F.col("text").cast("string"), _BREAK), lambda x: F.btrim(x, F.lit(_SPACE))), lambda x: x != "")
    cut = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lines.alias("lines"))
    judged = cut.select("doc_id", "lines", F.array_distinct(F.filter("lines", line_passes)).alias("kept"))
    sizes = F.try_divide(F.length(F.array_join("kept", "")), F.length(F.array_join("lines", "")))
    # a generated row is judged once: filters aren't pushed below it with all their expressions
    row = F.struct(F.array_join("kept", "\n").alias("text"), F.size("lines").alias("n_lines"), F.size("kept").alias("n_kept"), sizes.alias("kept_share"))
    out = judged.where("lines is not null").select("doc_id", F.explode(F.array(row)).alias("row")).select("doc_id", "row.*")
    return out.where((F.col("n_kept") > 0) & (F.col("kept_share") >= 1 - most_lost))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = rf"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, {_quoted(_BREAK)}), lambda x: trim(x, {_quoted(_SPACE)})), lambda x: x <> '') AS lines
  FROM documents WHERE text IS NOT NULL),
passed AS (
  SELECT doc_id, lines, list_filter(lines, lambda x:
    regexp_matches(x, {_quoted(f"[{_in_class(TERMINAL)}][{_in_class(CLOSING)}]*$")})
    AND length(regexp_replace(x, '[\p{{L}}\p{{M}}\p{{N}}\s]+', '', 'g')) <= length(regexp_replace(x, '\s+', '', 'g')) * {MOST_MARKS}
    AND NOT (length(x) - length(translate(x, '{SEPARATORS}', '')) >= {LEAST_SEPARATORS}
             AND length(x) - length(translate(x, '{SEPARATORS}', '')) >= len(string_split_regex(x, '\s+')) * {SEPARATOR_SHARE})
    AND NOT (len(string_split_regex(x, '\s+')) <= {BOILERPLATE_WORDS} AND regexp_matches(x, {_quoted(BOILERPLATE)}))) AS good
  FROM cut),
judged AS (SELECT doc_id, lines, list_filter(good, lambda x, i: list_position(good, x) = i) AS kept FROM passed)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, len(lines)::INTEGER AS n_lines, len(kept)::INTEGER AS n_kept,
       length(array_to_string(kept, ''))::DOUBLE / length(array_to_string(lines, '')) AS kept_share
FROM judged WHERE len(kept) > 0 AND length(array_to_string(kept, ''))::DOUBLE / length(array_to_string(lines, '')) >= {1 - MOST_LOST}
"""
