"""String, date, colour and JSON functions.  Each takes and returns columns; names of columns are accepted too."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns
from .norm import fold_accents, text

#: Words that title case leaves in lower case.
MINOR_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "in", "nor", "of", "on", "or", "so", "the", "to", "up", "yet", "is")
#: Characters that end a word in title case.
TERMINALS, INTERNALS, ENCLOSERS, DIVISIVES = "!?.;:\n", " ,", "([{", "/\\-"
#: The same in sets of regular expressions: what ends a part, and what stands between its words.
TITLE_ENDS, TITLE_BETWEEN = (re.escape(x).replace("/", "\\/") for x in (TERMINALS + ENCLOSERS + DIVISIVES, INTERNALS))


def age(start: Column | str, end: Column | date | None = None) -> Column:
    """Whole years from start to end (today if none), as (yyyymmdd - yyyymmdd) / 10000 towards zero."""
    number = lambda d: F.date_format(d.cast("date"), "yyyyMMdd").cast("int")
    end = F.current_date() if end is None else F.lit(end) if isinstance(end, date) else F.coalesce(text(end), F.current_date())
    return ((number(end) - number(text(start))) / 10000).cast("int")


def extract_param(string: Column | str, key: str, separator: str = ";", include_key: bool = False) -> Column:
    """The value after the first match of ``key`` (a LIKE pattern), up to the next separator or the end; null if the key is absent."""
    s = text(string)
    regex = f"({patterns.to_regex(key)})([^{re.escape(separator)}]*)"
    groups = F.regexp_extract(s, regex, 2)
    found = F.concat(F.regexp_extract(s, regex, 1), groups) if include_key else groups
    return F.when(s.rlike(regex), found)


def extract_pattern(string: Column | str, pattern: str = "[A..Z,0-9]", pattern_length: int = 1) -> Column:
    """Keeps what matches the pattern: windows of ``pattern_length`` that do not match are deleted, after a match the window moves by one."""
    s = text(string)
    if pattern_length == 1 and patterns.width(pattern) == 1:
        tail = F.regexp_extract(s, "( *)$", 1)
        one = patterns.to_regex(pattern)
        return F.concat(F.regexp_replace(F.rtrim(s), f"(?!{one})[\\s\\S]", F.lit("")), tail)
    if patterns.width(pattern) == pattern_length:
        # from left to right: blanks at the end stay, the first character of a window that matches stays, another window goes
        windows = f"( +\\z)|(?={patterns.to_regex(pattern)})([\\s\\S])|[\\s\\S]{{1,{pattern_length}}}"
        return F.regexp_replace(s, windows, F.lit("$1$2"))
    return _mapped(lambda x: extract_pattern_text(x, pattern, pattern_length))(s)


@lru_cache(maxsize=256)
def _compiled(pattern: str) -> re.Pattern[str]:
    return patterns.compiled(pattern)


def extract_param_text(value: str, key: str, separator: str, include_key: bool) -> str | None:
    """``extract_param`` of one string."""
    found = _compiled(key).search(value)
    if not found:
        return None
    end = value.find(separator, found.end()) if separator else -1
    return value[found.start() if include_key else found.end() : end if end >= 0 else len(value)]


def extract_pattern_text(value: str, pattern: str, pattern_length: int) -> str:
    """``extract_pattern`` of one string."""
    exact = _compiled(pattern)
    out, at = [], 0
    end = len(value.rstrip(" "))
    while at < end:
        if exact.fullmatch(value[at : at + pattern_length]):
            out.append(value[at])
            at += 1
        else:
            at += pattern_length
    return "".join(out) + value[at:]


def replace_text(value: str, old: str | None, new: str | None, strict: bool) -> str | None:
    """``replace_all`` of one string."""
    if not old:
        return value
    is_set = "]" in old
    pattern = _compiled(old)
    if new is None:
        return None if pattern.search(value) else value
    if strict and new in value:
        return value
    once = pattern.search(new) is not None
    for _ in range(len(value) + 64):
        after = pattern.sub(lambda _m: new, value) if is_set else value.replace(old, new)
        if once or after == value:
            return after
        value = after
    raise ValueError(f"replacing {old!r} by {new!r} does not settle")


def _mapped(function):
    """A string function over Arrow batches, null for null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(function, na_action="ignore")

    return F.pandas_udf(run, "string")


def fingerprint(string: Column | str) -> Column:
    """Lower case, with everything but Latin letters and digits removed."""
    return F.regexp_replace(F.lower(text(string)), "[^\\p{IsLatin}0-9]", F.lit(""))


def replace_all(string: Column | str, old: str | None, new: str | None, strict: bool = True) -> Column:
    """Replaces ``old`` (text, or a pattern if it holds ``]``) by ``new`` until nothing changes.

    With ``strict`` a string that already holds ``new`` stays.  If ``new`` holds ``old`` there is one pass only.
    Null ``old`` leaves the string; null ``new`` gives null where ``old`` is found.
    """
    s = text(string)
    if old is None or old == "":
        return s
    is_set = "]" in old
    regex = patterns.to_regex(old) if is_set else re.escape(old)
    if new is None:
        return F.when(~s.rlike(patterns.to_regex(old)), s)
    once = patterns.compiled(old).search(new) is not None
    if once or is_set and len(new) == 0 and patterns.width(old) == 1:
        done = F.regexp_replace(s, regex, F.lit(new.replace("\\", "\\\\").replace("$", "\\$"))) if is_set else F.replace(s, F.lit(old), F.lit(new))
    elif old == new * 2 and len(new) == 1 and not is_set:  # collapsing runs
        done = F.regexp_replace(s, f"{re.escape(new)}{{2,}}", F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))
    else:
        done = _settled(s, lambda x: x.rlike(regex) if is_set else x.contains(old), lambda x: F.regexp_replace(x, regex, F.lit(new.replace("\\", "\\\\").replace("$", "\\$"))) if is_set else F.replace(x, F.lit(old), F.lit(new)), f"replacing {old!r} by {new!r} does not settle")
    return F.when(s.contains(new), s).otherwise(done) if strict else done


def _settled(s: Column, starts: Callable[[Column], Column], once: Callable[[Column], Column], error: str) -> Column:
    """``once`` until nothing changes, in at least as many passes as the text has characters, and 64; an error if it still changes then.

    What makes texts shorter always settles.  Passes go in turns of about the root of their number, and what has settled sits the others out."""
    turns = F.ceil(F.sqrt(F.length(s) + 64)).cast("int")
    passed = lambda state, _: F.when(state["open"], F.struct(once(state["now"]).alias("now"), (once(state["now"]) != state["now"]).alias("open"))).otherwise(state)
    turn = lambda state, _: F.when(state["open"], F.aggregate(F.sequence(F.lit(1), turns), state, passed)).otherwise(state)
    end = lambda state: F.when(state["open"], F.raise_error(F.lit(error)).cast("string")).otherwise(state["now"])
    rest = lambda now: F.when(starts(now), F.aggregate(F.sequence(F.lit(1), turns), F.struct(now.alias("now"), F.lit(True).alias("open")), turn, end)).otherwise(now)
    return F.get(F.transform(F.array(once(once(once(s)))), rest), F.lit(0))  # most texts are done after three; an array of one, so that these are made once


def _raise(c: Column) -> Column:
    """Upper case of one character; a sharp s stays, as its capital is two letters."""
    return F.when(c == "ß", c).otherwise(F.upper(c))


def start_case(string: Column | str) -> Column:
    """Lower case, then capitals at the start and after blank, hyphen, backslash, ampersand, tab and line ends."""
    words = F.split(F.lower(text(string)), "(?<=[ \\-\\\\&\t\n\r])")
    return F.array_join(F.transform(words, lambda x: F.concat(_raise(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def title_case(string: Column | str) -> Column:
    """Title case, with minor words in lower case but at the start and after terminals, brackets and slashes; null for an empty text.

    Every part that such a character ends starts anew: its first word, after blanks and commas, is raised, and of the others all but minor words."""
    s = text(string)
    ends, between = TITLE_ENDS, TITLE_BETWEEN
    parts = F.split(F.lower(s), f"(?<=[{ends}])", -1)

    def raised(part: Column) -> Column:
        first = F.length(F.regexp_extract(part, f"^[{between}]*", 0))
        stays = lambda word, k: F.rtrim(word).isin(*MINOR_WORDS) & (k != first)
        return F.array_join(F.transform(F.split(part, f"(?<=[{between}])", -1), lambda word, k: F.when(stays(word, k), word).otherwise(F.concat(_raise(F.substring(word, 1, 1)), F.substr(word, F.lit(2))))), "")

    return F.when(s != "", F.array_join(F.transform(parts, raised), ""))


def string_split_item(string: Column | str, separator: str = ",", item: int = 0) -> Column:
    """The item at a zero-based place; empty past the end or for null, the first for a negative place."""
    return F.coalesce(F.get(F.split(text(string), re.escape(separator), -1), F.lit(max(item, 0))), F.lit(""))


def split_rows(string: Column | str, separator: str = ",") -> Column:
    """Array of (value, ordinal) for ``inline``: values trimmed of blanks, ordinals from zero."""
    return F.transform(F.split(text(string), re.escape(separator), -1), lambda x, i: F.struct(F.trim(x).alias("value"), i.cast("int").alias("ordinal")))


def hexcode_to_rgb(code: Column | str) -> Column:
    """Array of (rgb, value) for ``inline``: three rows; null values for null; no rows for codes of another length; digits that are none are an error."""
    c = text(code)
    full = F.when(F.length(c) == 4, F.regexp_replace(F.substring(c, 2, 3), "([\\s\\S])", "$1$1")).otherwise(F.substring(c, 2, 6))
    sound = F.when(full.rlike("^[0-9A-Fa-f]{6}$"), full).otherwise(F.raise_error(F.concat(F.lit("not a colour: "), c)).cast("string"))
    one = lambda name, at: F.struct(F.lit(name).alias("rgb"), F.conv(F.substring(sound, at, 2), 16, 10).cast("int").alias("value"))
    nothing = F.array(*(F.struct(F.lit(name).alias("rgb"), F.lit(None).cast("int").alias("value")) for name in "rgb"))
    rows = F.array(one("r", 1), one("g", 3), one("b", 5))
    return F.when(c.isNull(), nothing).when(F.length(c).isin(4, 7), rows).otherwise(F.array().cast("array<struct<rgb:string,value:int>>"))


def _channel(code: Column, at: int) -> Column:
    wide = F.when(F.length(code) == 4, F.regexp_replace(F.substring(code, 2, 3), "(.)", "$1$1")).otherwise(F.substring(code, 2, 6))
    return F.conv(F.substring(wide, at, 2), 16, 10).cast("double")


def gradient_hex(target: Column | str, lower: Column | float, upper: Column | float, hexmin: Column | str, hexmax: Column | str) -> Column:
    """The colour at ``target`` on the way from ``hexmin`` at lower to ``hexmax`` at upper; channels are cut to whole numbers and wrap."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    t, lo, hi, a, b = text(target).cast("double"), as_column(lower).cast("double"), as_column(upper).cast("double"), as_column(hexmin), as_column(hexmax)
    share = F.try_divide(t - lo, hi - lo)
    part = lambda at: F.lpad(F.hex(F.pmod((_channel(a, at) + (_channel(b, at) - _channel(a, at)) * share).cast("long"), F.lit(256))), 2, "0")
    return F.when(lo == hi, a).otherwise(F.concat(F.lit("#"), part(1), part(3), part(5)))


#: Blanks between tokens of JSON, beyond those that ``\\s`` means.
_BLANK = "\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Strings (to their end, or that of the text), marks, and other words.
JSON_TOKEN = f'"[^"\\\\]*+(?:\\\\[\\s\\S][^"\\\\]*+)*+(?:"|\\z)|[{{}}\\[\\]:,]|[^{_BLANK}{{}}\\[\\]:,"]+'
#: Tokens that one inner fold lays out; the texts of these are joined at the end, so that no long text is copied for each token.
FOLD = 256


def json_formatter(string: Column | str) -> Column:
    """JSON laid out a line for each item, indented with tabs.  Values are not parsed: key order and number text stay."""
    found = F.regexp_extract_all(F.translate(text(string), "\n\t", ""), F.lit(JSON_TOKEN), F.lit(0))
    tabs = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit("\t"), depth))

    def laid(state: Column, token: Column) -> Column:
        depth, outer = state["depth"], F.greatest(state["depth"] - 1, F.lit(0))
        piece = (
            F.when(token == ":", F.lit(": "))
            .when(token.isin("}", "]"), F.concat(tabs(outer), token))
            .when((token == ",") | (state["before"] == ":"), token)
            .otherwise(F.concat(tabs(depth), token))
        )
        after = F.when(token.isin("{", "["), depth + 1).when(token.isin("}", "]"), outer).otherwise(depth)
        return F.struct(F.concat(state["out"], piece).alias("out"), after.alias("depth"), token.alias("before"))

    def whole(tokens: Column) -> Column:
        def part(state: Column, k: Column) -> Column:
            last = state["last"]
            start = F.struct(F.lit("").alias("out"), last["depth"].alias("depth"), last["before"].alias("before"))
            return F.struct(F.concat(state["parts"], F.array(last["out"])).alias("parts"), F.aggregate(F.slice(tokens, k * FOLD + 1, F.lit(FOLD)), start, laid).alias("last"))

        nothing = F.struct(F.array().cast("array<string>").alias("parts"), F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit("").alias("before")).alias("last"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / FOLD).cast("int"))
        out = F.aggregate(numbers, nothing, part, lambda state: F.array_join(F.concat(state["parts"], F.array(state["last"]["out"])), ""))
        return F.when(F.size(tokens) == 0, "").when(F.size(tokens) > 0, F.regexp_replace(out, "\\A\n", F.lit("")))

    return F.get(F.transform(F.array(found), whole), F.lit(0))  # an array of one, so that tokens are taken once


__all__ = [
    "age", "extract_param", "extract_pattern", "fingerprint", "fold_accents", "gradient_hex", "hexcode_to_rgb", "json_formatter",
    "replace_all", "split_rows", "start_case", "string_split_item", "title_case",
]
