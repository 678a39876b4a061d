"""Acceptance rules and text functions as columns.

Ordinary texts, letters of all scripts, plain numbers and dates are judged by Spark's own functions. What Spark has no exact form of (odd
spellings of numbers and dates) goes to one Arrow UDF, which gets nulls for all other rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime
from decimal import Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Rule

# The characters that Python's str.strip() removes.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# The kinds of change, as reports name them.
TO_VALUE, TO_BLANK, SPACE, CASE, CASE_SPACE, NUMBER, OTHER = "Blank → value", "Value → blank", "Whitespace only", "Case only", "Case and whitespace", "Numeric formatting", "Other value change"
PLAIN_NUMBER = r"^[+-]?\d{1,18}(\.\d{1,18})?$"
#: Every ASCII text that Python's Decimal reads as a finite number is made of these.
NUMBER_CHARACTERS = r"^[0-9_.eE+\-\s\x1c-\x1f]+$"
NULL_SHOWN = "[NULL]"
_EXACT = Context(prec=4000)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


# Case folding, taken from str.casefold() itself: characters that become one, and those that become several.
_FOLDS = {c: c.casefold() for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if c.casefold() != c}
ONE = {a: b for a, b in _FOLDS.items() if len(b) == 1}
SEVERAL = {a: b for a, b in _FOLDS.items() if len(b) > 1}


def folded(c: Column) -> Column:
    """str.casefold() on the JVM: ASCII in lower case; other texts by a table of characters; and those with one that becomes
    several, such as ß, character by character."""
    table = F.create_map(*[F.lit(x) for pair in SEVERAL.items() for x in pair])
    one = F.translate(c, "".join(ONE), "".join(ONE.values()))
    each = F.array_join(F.transform(F.split(one, ""), lambda x: F.coalesce(table[x], x)), "")
    return F.when(ascii_only(c), F.lower(c)).when(c.rlike("[" + "".join(SEVERAL) + "]"), each).otherwise(one)


def changed_middle(a: Column, b: Column, limit: int = 2000) -> Column:
    """What two texts have in common at their ends, and what lies between: a struct (prefix, left, right, suffix) of the first `limit` characters. The
    lengths are found by bisection over substrings."""
    x, y = F.substring(a, 1, limit), F.substring(b, 1, limit)
    most, steps = F.least(F.char_length(x), F.char_length(y)), F.sequence(F.lit(1), F.lit(limit.bit_length()))

    def longest(high: Column, same) -> Column:
        """The largest n up to high of which same(n) holds; it holds of all below."""
        start = F.struct(F.lit(0).alias("low"), high.alias("high"))

        def step(s: Column, _: Column) -> Column:
            middle = ((s["low"] + s["high"] + 1) / 2).cast("int")
            ok = same(middle)
            return F.struct(F.when(ok, middle).otherwise(s["low"]).alias("low"), F.when(ok, s["high"]).otherwise(F.greatest(middle - 1, s["low"])).alias("high"))

        return F.aggregate(steps, start, step, lambda s: s["low"])

    first = longest(most, lambda n: F.left(x, n) == F.left(y, n))
    last = longest(most - first, lambda n: F.right(x, n) == F.right(y, n))
    part = lambda t: F.substring(t, first + 1, F.char_length(t) - first - last)
    return F.struct(F.left(x, first).alias("prefix"), part(x).alias("left"), part(y).alias("right"), F.right(x, last).alias("suffix"))


def number(text: str | None) -> Decimal | None:
    """A finite decimal of at most 1000 characters with exponents within 1000, or None."""
    if text is None or len(text) > 1000:
        return None
    try:
        d = Decimal(text)
    except InvalidOperation:
        return None
    return d if d.is_finite() and abs(d.adjusted()) <= 1000 and abs(int(d.as_tuple().exponent)) <= 1000 else None


def near(x: str | None, y: str | None, limit: Decimal) -> bool:
    a, b = number(x), number(y)
    return a is not None and b is not None and abs(_EXACT.subtract(a, b)) <= limit


def _moment(text: str, form: str) -> datetime | None:
    try:
        return datetime.strptime(text, form)
    except ValueError:
        return None


def accepts(rule: Rule, x: str | None, y: str | None) -> bool:
    """Whether the rule makes two texts equal; a null is equal to a null only. What accepted_by() must agree with."""
    if x is None or y is None:
        return x is y
    if rule.trim:
        x, y = x.strip(), y.strip()
    if rule.ignore_case:
        x, y = x.casefold(), y.casefold()
    if x == y:
        return True
    if rule.left_date_format:
        at = _moment(x, rule.left_date_format)
        return at is not None and at == _moment(y, rule.right_date_format or "")
    return rule.tolerance is not None and near(x, y, Decimal(rule.tolerance))


def change_kind(x: str, y: str) -> str:
    """The kind of change between two shown texts, the first that fits. What pattern() must agree with."""
    a, b = x.strip(), y.strip()
    if bool(a) != bool(b):
        return TO_BLANK if a else TO_VALUE
    if a == b:
        return SPACE
    if x.casefold() == y.casefold():
        return CASE
    if a.casefold() == b.casefold():
        return CASE_SPACE
    return NUMBER if near(a, b, Decimal(0)) else OTHER


def _plain_close(a: Column, b: Column, tolerance: str) -> tuple[Column, Column]:
    """(decidable, result) of |a - b| <= tolerance by Spark's decimals: of two plain numbers, or where one text is none."""
    t = Decimal(tolerance)
    plain = a.rlike(PLAIN_NUMBER) & b.rlike(PLAIN_NUMBER)
    no_number = ascii_only(a) & ascii_only(b) & ~(a.rlike(NUMBER_CHARACTERS) & b.rlike(NUMBER_CHARACTERS))
    if t != t.quantize(Decimal(1).scaleb(-18), context=_EXACT) or t >= Decimal(10) ** 18:
        return no_number, F.lit(False)
    gap = F.abs(a.try_cast("decimal(36,18)") - b.try_cast("decimal(36,18)"))
    return plain | no_number, plain & F.coalesce(gap <= F.lit(str(t)).cast("decimal(37,18)"), F.lit(False))


def close(a: Column, b: Column, tolerance: str) -> Column:
    """|a - b| <= tolerance, exactly. False where one is no number."""
    limit = Decimal(tolerance)
    decidable, result = _plain_close(a, b, tolerance)

    @F.pandas_udf(T.BooleanType())
    def rest(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([near(p, q, limit) for p, q in zip(x, y, strict=True)], dtype=bool)

    rare = a.isNotNull() & b.isNotNull() & ~decidable
    return F.when(a.isNull() | b.isNull(), False).when(decidable, result).otherwise(rest(F.when(rare, a), F.when(rare, b)))


# The digits that the library's date directives take, and the number each stands for where a format lacks it.
DIGITS = {"Y": r"(?!0000)\d{4}", "m": "1[0-2]|0[1-9]|[1-9]", "d": r"3[01]|[12]\d|0[1-9]|[1-9]", "H": r"2[0-3]|[01]\d|\d", "M": r"[0-5]\d|\d", "S": r"[0-5]\d|\d"}
MISSING = {"Y": 1900, "m": 1, "d": 1, "H": 0, "M": 0, "S": 0}


def date_shape(form: str) -> tuple[str, list[str]] | None:
    """(a pattern with a group for each directive, the directives) of a date format whose texts it alone decides, or None. A text that
    matches means what strptime() reads; one that does not is for strptime() itself to judge (other digits, cases, blanks)."""
    parts = re.findall(r"%(.)|([^%])", form, re.DOTALL)
    if sum(1 + bool(d) for d, _ in parts) != len(form) or any(d and d not in DIGITS or t and not t.isascii() for d, t in parts):
        return None
    names = [d for d, _ in parts if d]
    if not names or len(set(names)) < len(names):
        return None
    touching = any(a and b for (a, _), (b, _) in zip(parts, parts[1:], strict=False)) or any(t.isdigit() for _, t in parts)
    digits = {k: v if not touching else "|".join(x for x in v.split("|") if x not in (r"\d", "[1-9]")) for k, v in DIGITS.items()}
    blank = lambda t: r"\s+" if t.isspace() else re.escape(t)
    out = "".join(f"({digits[d]})" if d else blank(t) for d, t in parts)
    return f"^{re.sub(r'(?:%s)+' % re.escape(chr(92) + 's+'), lambda _: chr(92) + 's+', out)}\\z", names


def _moment_column(c: Column, shape: tuple[str, list[str]]) -> tuple[Column, Column]:
    """(whether the shape decides the text, its moment, null for days that no month has)."""
    pattern, names = shape
    part = {d: F.regexp_extract(c, pattern, k + 1).cast("int") if k >= 0 else F.lit(MISSING[d]) for d in DIGITS for k in [names.index(d) if d in names else -1]}
    matched = c.rlike(pattern)
    return matched, F.when(matched, F.call_function("try_make_timestamp_ntz", *[part[d] for d in "YmdHM"], part["S"].cast("decimal(16,6)")))


def _plain_date(rule: Rule, a: Column, b: Column) -> tuple[Column, Column]:
    """(decidable, result) of a date rule by Spark's functions. An empty text is no date."""
    shapes = [date_shape(f or "") for f in (rule.left_date_format, rule.right_date_format)]
    empty = (a == "") | (b == "")
    if None in shapes:
        return F.lit(False), F.lit(False)
    (known_a, at_a), (known_b, at_b) = (_moment_column(c, s) for c, s in zip((a, b), shapes, strict=True))
    return empty | (known_a & known_b), ~empty & F.coalesce(at_a == at_b, F.lit(False))


def _plain_rule(rule: Rule, a: Column, b: Column) -> tuple[Column, Column]:
    """(decidable, result) of a rule by Spark's functions; both texts are there."""
    decidable = F.lit(True)
    if rule.trim:
        a, b = trimmed(a), trimmed(b)
    if rule.ignore_case:
        a, b = folded(a), folded(b)
    same = a == b
    if rule.left_date_format:
        known, equal = _plain_date(rule, a, b)
        return decidable & (same | known), same | equal
    if rule.tolerance is not None:
        known, near_by = _plain_close(a, b, rule.tolerance)
        return decidable & (same | known), same | near_by
    return decidable, same


def accepted_by(rules: Sequence[Rule], column: Column, a: Column, b: Column) -> Column:
    """Whether a cell's rule makes its two texts equal: never null, false for columns without a rule."""
    if not rules:
        return F.lit(False)
    known, same = [], []
    for r in rules:
        of = column == r.column
        for cases, value in zip((known, same), _plain_rule(r, F.when(of, a), F.when(of, b)), strict=True):
            cases.append(F.when(of, value))
    decidable, result = F.coalesce(*known, F.lit(True)), F.coalesce(*same, F.lit(False))
    both = a.isNotNull() & b.isNotNull()
    plain = F.when(both, result).otherwise(F.coalesce(column.isin([r.column for r in rules]), F.lit(False)) & a.isNull() & b.isNull())
    if not any(r.left_date_format or r.tolerance is not None for r in rules):
        return plain
    by_column = {r.column: r for r in rules}

    @F.pandas_udf(T.BooleanType())
    def rest(name: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([n is not None and accepts(by_column[n], p, q) for n, p, q in zip(name, x, y, strict=True)], dtype=bool)

    rare = both & ~decidable
    return F.when(rare, rest(F.when(rare, column), F.when(rare, a), F.when(rare, b))).otherwise(plain)


def shown(c: Column) -> Column:
    """A text as reports show it: a null as [NULL], and a text that reads so with a remark."""
    return F.when(c.isNull(), NULL_SHOWN).when(c == NULL_SHOWN, NULL_SHOWN + " (text)").otherwise(c)


@F.pandas_udf(T.StringType())
def _rare_kind(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else change_kind(p, q) for p, q in zip(x, y, strict=True)], dtype=object)


def pattern(a: Column, b: Column) -> Column:
    """The kind of change between two shown texts, the first that fits."""
    left, right = trimmed(a), trimmed(b)
    known, same = _plain_close(left, right, "0")
    decidable = known | (left == right) | (folded(left) == folded(right)) | ((left == "") != (right == ""))
    plain = (
        F.when((left == "") & (right != ""), TO_VALUE)
        .when((left != "") & (right == ""), TO_BLANK)
        .when(left == right, SPACE)
        .when(folded(a) == folded(b), CASE)
        .when(folded(left) == folded(right), CASE_SPACE)
        .when(same, NUMBER)
        .otherwise(OTHER)
    )
    return F.when(decidable, plain).otherwise(_rare_kind(F.when(~decidable, a), F.when(~decidable, b)))


def shortened(c: Column, limit: int) -> Column:
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(" … [truncated]"))).otherwise(c)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole)


def percent_text(value: Column) -> Column:
    """A percentage with four digits, N/A for null."""
    return F.coalesce(F.format_string("%.4f%%", value), F.lit("N/A"))


def difference_text(x: str | None, y: str | None) -> str:
    """x - y as an exact decimal, '' where one is no number."""
    a, b = number(x), number(y)
    return "" if a is None or b is None else str(_EXACT.subtract(a, b))


def numeric_difference(a: Column, b: Column) -> Column:
    """left - right as an exact decimal text, '' where one is no number. For samples and pages; not used to compare."""

    @F.pandas_udf(T.StringType())
    def delta(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difference_text(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    return delta(a, b)
