"""Scalar functions as column expressions, and their DuckDB SQL where a query needs it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of a line, without the line break.
BLANK = r"[ \t\x0B\f\r]"
#: Borders of clone tokens.
TOKEN_BREAK = r"[ \t\n\x0B\f\r]+"


def rounded(value: Column, digits: int = 2) -> Column:
    """Half away from zero on the scaled double: round(v * 10^d) / 10^d, which differs from round(v, d)."""
    scale = float(10**digits)
    return F.round(value * scale) / scale


def percent(part: Column, whole: Column) -> Column:
    """Null where the whole is 0: missing is not zero."""
    return F.when(whole != 0, rounded(part / whole * 100.0))


def number_text(value: Column) -> Column:
    """The shortest decimal text, without a fraction of zero and never with an exponent."""
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value.isNotNull(), plain)


def short_id(*parts: Column) -> Column:
    """The first 20 hexadecimal digits of the SHA-256 of the parts with a zero character between them."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256), 1, 20)


def exceeds(value: Column, threshold: Column, enabled: Column) -> Column:
    """Strictly above an enabled threshold."""
    return enabled & (value > threshold)


def excess(current: Column, threshold: Column) -> Column:
    """How many times the threshold; 0 where either is missing or the threshold is not positive."""
    return F.coalesce(F.when(threshold > 0, current / threshold), F.lit(0.0))


def location(file: Column, line: Column, key: Column) -> Column:
    """file:line, else file, else key."""
    return F.coalesce(F.when(line.isNotNull() & (line > 0), F.concat(file, F.lit(":"), line.cast("string"))), file, key)


def symbol_name(class_name: Column, enclosing: Column, name: Column) -> Column:
    """[Class.][Enclosing.]Name"""
    present = lambda c: F.when(c != "", c)
    return F.concat_ws(".", present(class_name), present(enclosing), name)


def clone_key(members: Column) -> Column:
    return F.concat(F.lit("clone:"), F.array_join(F.array_sort(members), "|"))


def folder(path: Column) -> Column:
    """The folder of a path; empty for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """The last dot of the name and what follows it, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def with_file(key: Column, file: Column, new: Column) -> Column:
    """A key that is a file, or begins with file::, for another file; other keys stay."""
    return F.when(key == file, new).when(F.startswith(key, F.concat(file, F.lit("::"))), F.concat(new, F.substring(key, F.length(file) + 1, F.length(key)))).otherwise(key)


def is_active(classification: Column) -> Column:
    """Not resolved; what was not compared counts as new."""
    return F.coalesce(classification, F.lit("new")) != "resolved"


def is_regression(classification: Column) -> Column:
    """New or worsened; what was not compared counts as new."""
    return F.coalesce(classification, F.lit("new")).isin("new", "worsened")


def blocks_gate(blocking: Column, classification: Column) -> Column:
    """A blocking finding that is new or worsened: what was there before and grew no worse does not fail the gate."""
    return F.coalesce(blocking, F.lit(False)) & is_regression(classification)


def utc_millis(at: Column) -> Column:
    """A time as text in UTC with milliseconds; the session's time zone has to be UTC for times without one."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def nonblank_lines(code: Column) -> Column:
    return F.size(F.filter(F.split(code, "\n", -1), lambda line: line.rlike(r"[^ \t\x0B\f\r]"))).cast("long")


def tokens(code: Column) -> Column:
    """The runs of a text between white space."""
    return F.filter(F.split(code, TOKEN_BREAK, -1), lambda t: t != "")


def glob_regex(pattern: str) -> str:
    """A path pattern as an anchored regular expression: ** crosses folders, * and ? do not, {a,b} are alternatives."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
            continue
        if c == "[" and "]" not in pattern[i + 2 :] or c == "\\" and i + 1 == len(pattern):
            raise ValueError(f"invalid pattern: {pattern}")
        if c == "[":
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"invalid pattern: {pattern}")
    return f"^{out}$"


def glob_any(path: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns matches; an invalid pattern matches nothing."""
    out = F.lit(False)
    for p in patterns:
        try:
            out = out | path.rlike(glob_regex(p))
        except ValueError:
            continue
    return out


def stable_json(value) -> str:
    """Canonical JSON of a driver-side value: sorted keys, no white space, and <, >, & escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
