"""Amount and date candidates in text, as column expressions.

Each scanner's pattern is run over the text once; what it finds is then taken apart match by match, by its
letters and not by the pattern again, which may look beyond a match.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import SETTINGS
from .text import SPACE, SPACES, strip

# Patterns.
SYMBOL = "[$€£¥₹]"
CODE = "(?:USD|EUR|GBP|JPY|INR|CAD|AUD|CHF)"
NUMBER = "[0-9]{1,3}(?:[,.][0-9]{3})*(?:[,.][0-9]{1,2})?|[0-9]+(?:[,.][0-9]{1,2})?"
#: Groups: 1 bracket, 2 minus, 3 and 4 symbol and code before, 5 number, 6 and 7 symbol and code after, 8 closing bracket.
AMOUNT = f"(\\()?(-{SPACE}?)?(?:({SYMBOL}){SPACE}?|({CODE}){SPACE}+)?({NUMBER})(?:{SPACE}?({SYMBOL})|{SPACE}+({CODE}))?(\\))?"
MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
#: A dotted date is none if it goes on as a longer row of numbers, before or behind: that is an address or a version.
_LONGER = "(?!\\d{1,2}\\.\\d{1,2}\\.\\d{2,4}\\.\\d|(?<=\\d\\.)\\d{1,2}\\.\\d{1,2}\\.)"
DATE = f"\\b(?:\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}|\\d{{1,2}}\\s+(?:{MONTH})\\w*,?\\s+\\d{{4}}|(?:{MONTH})\\w*\\s+\\d{{1,2}},?\\s+\\d{{4}}|{_LONGER}\\d{{1,2}}[/.\\-]\\d{{1,2}}[/.\\-]\\d{{2,4}})\\b"
BILL_WORDS = "(?i)\\b(?:due date|payment due|amount due|balance due|invoice|statement|account number|bill(?:ing)?|subscription|premium|autopay|remit)\\b"
DOTTED_DATE = "\\b\\d{1,2}\\.\\d{1,2}\\.\\d{2,4}\\b"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


#: All that a match holds beside its number.
_BESIDE = SPACES + "()-$€£¥₹" + "".join(map(chr, range(ord("A"), ord("Z") + 1)))
_BARE = SPACES + "()-0123456789,."


def _placed(number: Column) -> Column:
    """A number's text with the places of its last comma and last dot, counted from its end; 0 for none."""
    last = lambda c: F.when(F.contains(number, F.lit(c)), F.length(F.substring_index(number, c, -1)) + 1).otherwise(0)
    return F.struct(number.alias("text"), last(",").alias("comma"), last(".").alias("dot"))


def _value(n: Column) -> Column:
    comma, dot, text = n["comma"], n["dot"], n["text"]
    decimal_comma = F.when((comma > 0) & (dot > 0), comma < dot).otherwise(comma.isin(2, 3))
    without_commas = (comma > 0) | dot.isin(2, 3)
    plain = F.when(decimal_comma, F.translate(text, ",.", ".")).when(without_commas, F.translate(text, ",", "")).otherwise(F.translate(text, ".", ""))
    return plain.try_cast("double")


def amount_value(number: Column) -> Column:
    """The value of a number whose separators may be either way round; null if it can't be read.

    With both separators the later is the decimal one; a single kind is decimal if one or two digits follow its last."""
    return F.get(F.transform(F.array(_placed(number)), _value), F.lit(0))


def amount_candidates(text: Column, most: int | None = None) -> Column:
    """array of (raw, value): the first so many different amounts of a text, in order. Bare numbers need a decimal tail."""
    # A match holds digits and separators in its number alone, brackets, minus, symbols and codes elsewhere: each is told by its letters.
    parts = F.transform(
        F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)),
        lambda m: F.struct(m.alias("raw"), _placed(F.translate(m, _BESIDE, "")).alias("number"), (F.translate(m, _BARE, "") != "").alias("marked"), (F.translate(m, "()-", "") != m).alias("negative")),
    )
    money = F.filter(parts, lambda c: c["marked"] | c["number"]["comma"].isin(2, 3) | c["number"]["dot"].isin(2, 3))
    values = F.transform(money, lambda c: F.struct(strip(c["raw"]).alias("raw"), _value(c["number"]).alias("value"), c["negative"].alias("negative")))
    kept = F.transform(F.filter(values, lambda c: c["value"].isNotNull()), lambda c: F.struct(c["raw"].alias("raw"), F.when(c["negative"], -F.abs(c["value"])).otherwise(c["value"]).alias("value")))
    return F.slice(F.array_distinct(kept), 1, most or SETTINGS.most_candidates)


def lines_of(text: Column, raws: Column) -> Column:
    """For each raw candidate the line around its first place in the text, trimmed. A place counts if no letter or digit of the candidate's
    own kind goes on beyond either end, as in a longer number; without such a place the first one counts."""

    def line(raw: Column) -> Column:
        whole = F.concat(F.lit("(?U)(?<![0-9,.])\\Q"), raw, F.lit("\\E(?![0-9]|[,.][0-9])"))
        place = F.regexp_instr(text, whole)
        at = F.when(place > 0, place).otherwise(F.call_function("instr", text, raw))
        before = F.substring_index(F.substr(text, F.lit(1), at - 1), "\n", -1)
        after = F.substring_index(F.substr(text, at), "\n", 1)
        return strip(F.concat(before, after))

    return F.transform(raws, line)


def day_first(text: Column) -> Column:
    """Whether a text's dates are read day first: it has a euro or pound sign, or a dotted date."""
    return text.rlike("[€£]") | text.rlike("(?U)" + DOTTED_DATE)


def _days(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _date_parts(raw: Column) -> Column:
    """A match of DATE as its three parts, texts and numbers, and what stands between them."""
    parts = F.array(F.split(raw, "[/.\\-]|,?\\s+", -1))
    step = F.transform(parts, lambda p: F.struct(raw.alias("raw"), F.translate(raw, "0123456789", "").alias("marks"), p.alias("p"), F.transform(p, lambda x: x.try_cast("int")).alias("n")))
    return F.get(step, F.lit(0))


def _date(d: Column, dayfirst: Column, pivot: int) -> Column:
    """The day that three parts mean, as a struct of numbers."""
    one, two, three = (F.get(d["n"], F.lit(k)) for k in range(3))
    size = lambda k: F.length(F.get(d["p"], F.lit(k)))
    day_is = lambda y, m, day: F.struct(y.alias("y"), m.alias("m"), day.alias("d"))

    def month(word: Column) -> Column:
        low = F.lower(word)
        by_name = F.array_position(F.array(*map(F.lit, MONTH_NAMES)), low)
        by_short = F.array_position(F.array(*map(F.lit, MONTHS)), F.when(low == "sept", "sep").otherwise(low))
        return F.greatest(by_name, by_short).cast("int")

    full = lambda y: F.lit(pivot - 50) + F.pmod(y - (pivot - 50), F.lit(100))
    marks, short = d["marks"], size(2) == 2
    iso = (marks == "--") & (size(0) == 4)
    numeric = (F.length(marks) == 2) & (F.translate(marks, "/.-", "") == "")
    # A dot beside another mark is no date.
    mixed = F.contains(marks, F.lit(".")) & (marks != "..")
    swapped, month_last = dayfirst & (three <= 12), dayfirst & (three <= 12)
    year, day_month = F.when(short, full(three)).otherwise(three), (one > 12) | (dayfirst & (two <= 12))
    named = month(F.get(d["p"], F.lit(1)))
    return (
        F.when(F.size(d["p"]) != 3, F.lit(None))
        .when(iso, F.when(swapped, day_is(one, three, two)).otherwise(day_is(one, two, three)))
        .when(numeric & mixed, F.lit(None))
        .when(numeric & (one > 31) & short, F.when(month_last, day_is(full(one), three, two)).otherwise(day_is(full(one), two, three)))
        .when(numeric, F.when(day_month, day_is(year, two, one)).otherwise(day_is(year, one, two)))
        .when(one.isNotNull(), day_is(three, named, one))
        .otherwise(day_is(three, month(F.get(d["p"], F.lit(0))), two))
    )


def _iso(d: Column) -> Column:
    y, m, day = d["y"], d["m"], d["d"]
    padded = lambda n, size: F.lpad(n.cast("string"), size, "0")
    return F.when((y >= 1) & (m >= 1) & (m <= 12) & (day >= 1) & (day <= _days(y, m)), F.concat_ws("-", padded(y, 4), padded(m, 2), padded(day, 2)))


def _dates(raws: Column, dayfirst: Column, pivot: int) -> Column:
    # Step by step, so that no part is worked out again wherever it is used.
    asked = F.array(F.struct(raws.alias("raws"), dayfirst.alias("first")))
    step = F.transform(asked, lambda a: F.transform(F.transform(a["raws"], _date_parts), lambda d: F.struct(d["raw"].alias("raw"), _date(d, a["first"], pivot).alias("day"))))
    return F.transform(F.get(step, F.lit(0)), lambda c: F.struct(c["raw"].alias("raw"), _iso(c["day"]).alias("iso")))


def date_iso(raw: Column, dayfirst: Column, pivot: int = 2025) -> Column:
    """The date that a match of DATE means, in ISO form; null if there is none. pivot: two-digit years lie within 50 years of it."""
    return F.get(_dates(F.array(raw), dayfirst, pivot), F.lit(0))["iso"]


def date_candidates(text: Column, most: int | None = None, pivot: int = 2025) -> Column:
    """array of (raw, iso): the first so many different dates of a text, in order."""
    found = _dates(F.regexp_extract_all(text, F.lit("(?U)" + DATE), F.lit(0)), day_first(text), pivot)
    return F.slice(F.array_distinct(F.filter(found, lambda c: c["iso"].isNotNull())), 1, most or SETTINGS.most_candidates)


def looks_like_bill(text: Column) -> Column:
    return F.coalesce(text.rlike("(?U)" + BILL_WORDS) & (F.size(amount_candidates(text, 1)) > 0), F.lit(False))


__all__ = ["AMOUNT", "BILL_WORDS", "CODE", "DATE", "MONTH", "NUMBER", "SPACES", "SYMBOL", "amount_candidates", "amount_value", "date_candidates", "date_iso", "day_first", "lines_of", "looks_like_bill"]
