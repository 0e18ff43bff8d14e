"""Regular expressions of the scanned languages in Spark, and where all their matches are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as white space, inside a character class.
SPACES = r"\t\n\x0B\f\r \u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WHITE = f"[{SPACES}]"
_SPACES = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0xFEFF, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _alternatives(pattern: str) -> tuple[list[str], int]:
    """What ``|`` separates in a pattern, or in the group that it begins with, and the length of that."""
    group, depth, inside, k, out = pattern.startswith("(?:"), 0, False, 0, [""]
    while k < len(pattern):
        c = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        k += len(c)
        inside = inside and c != "]" or c == "["
        depth += (c == "(") - (c == ")") if not inside else 0
        if c == "|" and depth == group and not inside:
            out.append("")
            continue
        out[-1] += c
        if group and not depth and not inside:
            break
    return ([out[0][3:], *out[1:-1], out[-1][:-1]] if group and len(out) > 1 else out), k


def _first(pattern: str) -> str:
    """A pattern that begins with alternatives, with a look at their first letters before any is tried."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    rest = pattern[len(flags) :]
    each, end = _alternatives(rest)
    if len(each) < 2 or not all(re.match(r"[A-Za-z](?![?*+{])", x) for x in each) or rest[end : end + 1] in ("?", "*", "+", "{"):
        return pattern
    return f"{flags}(?=[{''.join(dict.fromkeys(x[0] for x in each))}])(?:{'|'.join(each)}){rest[end:]}"


def dialect(pattern: str) -> str:
    """An ECMAScript pattern as Java reads it: ASCII word edges, Unicode white space, and a dot that stops at line ends only."""
    pattern, out, inside, k = _first(pattern), [], False, 0
    while k < len(pattern):
        c = pattern[k : k + 2]
        if c == r"\b" and not inside:
            # the word first, which is searched for fast, and then the look behind it
            word = re.match(r"[A-Za-z0-9]*(?![?*+{A-Za-z0-9])", pattern[k + 2 :])
            word = word[0] if word else ""
            out.append(f"{word}(?<![A-Za-z0-9_]{word})" if word or pattern[k + 2 : k + 3].isalnum() else "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
            k += 2 + len(word)
        elif c == r"\s":
            out.append(SPACES if inside else WHITE)
            k += 2
        elif c[0] == "\\":
            out.append(c)
            k += 2
        else:
            inside = inside and c[0] != "]" or c[0] == "["
            out.append(r"[^\n\r\u2028\u2029]" if c[0] == "." and not inside else c[0])
            k += 1
    return "".join(out)


def once(df: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """``kept`` and ``made`` columns; a generated row isn't made again, however many filters and columns behind it name what is in it."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def pieces(text: Column, pattern: str) -> Column:
    """All matches of a Java ``pattern`` (each of a character at least), each with what lies between it and the one before.

    The pattern is compiled once, not once a text as by ``split``.
    """
    return found(text, rf"\G(?s:.*?)(?:{pattern})")


def before(parts: Column, k: Column, match: Column) -> Column:
    """The text before the ``k``-th match, from 0, of :func:`pieces`."""
    upto = F.when(k == 0, F.get(parts, F.lit(0))).otherwise(F.array_join(F.slice(parts, F.lit(1), k + 1), ""))
    return F.left(upto, F.length(upto) - F.length(match))


def line_after(prefix: Column) -> Column:
    """The number, from 1, of the line that what follows ``prefix`` begins in."""
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_after(prefix: Column) -> Column:
    """Place in its line, from 1, in code points."""
    return (F.length(F.substring_index(prefix, "\n", -1)) + 1).cast("int")


def line_text(text: Column, line: Column) -> Column:
    """The line of a number, untrimmed; empty where there is none."""
    return F.coalesce(F.get(F.split(text, "\n", -1), line - 1), F.lit(""))


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(_SPACES))


_STRING = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_TOKEN = rf"//[^\n]*|/\*[\s\S]*?\*/|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`|{_STRING}"
_KEPT = rf"[^/`\"']*(?:\bfrom|\bimport|\brequire\s*\(|\bimport\s*\()\s*[\x85\u2028\u2029]?(?:{_STRING})"
#: A whole text in pieces: what ends with a module specifier, other tokens, runs of what begins no token, and single characters that could have begun one.
_PIECE = rf"{_KEPT}|{_TOKEN}|[^/`\"']++|[/`\"']"


def masked(text: Column) -> Column:
    """Source text of the same length and lines, with comments, templates, and all strings but module specifiers blank."""
    blank = lambda t: F.when(t.rlike(r"^(?://|/\*|(?s:[`\"'].))"), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), blank), "")
