"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: All characters that count as white space at a text's ends.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: One white space character inside a pattern, for Java's and RE2's engines alike.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def basename(path: Column) -> Column:
    """What follows the last slash or backslash; 'Unknown' for no path."""
    whole = F.coalesce(F.nullif(path, F.lit("")), F.lit("Unknown"))
    return F.element_at(F.split(F.replace(whole, F.lit("\\"), F.lit("/")), "/", -1), -1)


def stable_id(source: Column) -> Column:
    return F.substring(F.sha1(source), 1, 12)


def extension(name: Column) -> Column:
    """The lower-cased ending with its dot, or nothing; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(basename(name), "(?s)^\\.*[^.].*(\\.[^.]*)$", 1))


def file_type(ext: Column) -> Column:
    return F.when(ext == ".pdf", "pdf").when(ext == ".docx", "doc").when(ext == ".md", "md").otherwise("txt")


def money(amount: Column) -> Column:
    """An amount for display: a dash for none, the sign before the currency."""
    digits = F.round(F.abs(amount).cast("decimal(38,6)"), 2).cast("decimal(38,2)").cast("string")
    return F.when(amount.isNull(), "—").otherwise(F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("$"), digits))


def short_date(iso: Column) -> Column:
    day = F.try_to_date(iso, "yyyy-MM-dd")
    return F.when(F.coalesce(iso, F.lit("")) == "", "—").otherwise(F.coalesce(F.date_format(day, "MMM d, yyyy"), iso))


def cite_label(source: Column, page: Column) -> Column:
    """A citation's file name, and its page if it has one that isn't 0."""
    name = F.when(F.coalesce(source, F.lit("")) == "", "source").otherwise(basename(source))
    return F.when(page.isNotNull() & (page != 0), F.concat(name, F.lit(" · p."), page.cast("string"))).otherwise(name)


def percent(value: Column) -> Column:
    """A value held between 0 and 100; 0 for none."""
    return F.least(F.greatest(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))


def page_number(page: Column) -> Column:
    """A page as a whole number: numbers are cut, strings of digits read, all else is 0."""
    text = page.cast("string")
    return F.when(text.rlike("^[0-9]+(\\.[0-9]*)?$"), F.floor(text.try_cast("double")).cast("int")).otherwise(0)


def fill(template: str, **values: Column) -> Column:
    """A prompt template with its placeholders replaced, one after the other."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def paragraphs(text: Column) -> Column:
    """The parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, f"\\n{SPACE}*\\n", -1), strip), lambda x: x != "")


def clean_metadata(meta: Column, as_type: str = "map<string,string>") -> Column:
    """A JSON object's entries as text, whatever their types; an empty map if it is no object."""
    return F.coalesce(F.from_json(meta, as_type), F.create_map().cast(as_type))
