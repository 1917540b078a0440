"""Bill records: candidates, a model's choice among them, its validation, edits and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import BILL_PROMPT, CATEGORIES, SETTINGS
from ..functions.candidates import BILL_WORDS, amount_candidates, date_candidates
from ..functions.once import once
from ..functions.stored import stored
from ..functions.text import fill, stable_id, strip
from ..sources import store


def with_candidates(documents: DataFrame, pivot: int = 2025) -> DataFrame:
    """documents (source, text) with amounts, dates and bill_like. Texts that don't look like bills aren't scanned further."""
    words = F.coalesce(F.col("text").rlike("(?U)" + BILL_WORDS), F.lit(False))
    rows = once(documents, amounts=amount_candidates(F.when(words, F.col("text")).otherwise("")))
    # As looks_like_bill says, with the amounts that are there already.
    rows = rows.withColumn("bill_like", F.size("amounts") > 0)
    return once(rows, dates=date_candidates(F.when(F.col("bill_like"), F.col("text")).otherwise(""), pivot=pivot))


def prompt(text: Column, amounts: Column, dates: Column) -> Column:
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x["raw"])), "\n")
    none = F.when(F.size(dates) == 0, "(none found)").otherwise(listed(dates))
    return fill(BILL_PROMPT, document_text=F.substring(text, 1, SETTINGS.bill_chars), amount_candidates=listed(amounts), date_candidates=none)


def choice_schema(amounts: Column, dates: Column) -> Column:
    """The JSON schema that binds a model's answer to the candidates."""
    options = lambda c: F.concat(F.transform(c, lambda x: x["raw"]), F.array(F.lit("")))
    enum = lambda c: F.struct(F.lit("string").alias("type"), c.alias("enum"))
    plain = lambda t: F.struct(F.lit(t).alias("type"))
    names = ["is_bill", "vendor", "category", "total_due", "due_date", "issue_date"]
    kinds = [plain("boolean"), plain("string"), enum(F.array(*map(F.lit, CATEGORIES))), enum(options(amounts)), enum(options(dates)), enum(options(dates))]
    properties = F.struct(*(k.alias(n) for n, k in zip(names, kinds, strict=True)))
    return F.to_json(F.struct(F.lit("object").alias("type"), properties.alias("properties"), F.array(*map(F.lit, names)).alias("required")))


def validated(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bill records of rows (source, amounts, dates, choice), with the columns to keep. A chosen text that is no candidate is kept, but its value is null and
    not confident; an unknown category is Other, a blank vendor Unknown."""

    def picked(name: str, candidates: str, value: str) -> tuple[Column, Column, Column]:
        raw = strip(F.coalesce(F.col(f"choice.{name}"), F.lit("")))
        # Later candidates of the same raw text would win, but raw texts are distinct.
        hit = F.filter(candidates, lambda c: c["raw"] == raw)
        found = F.size(hit) > 0
        return F.when(found, F.get(hit, F.lit(0))[value]), F.when(raw != "", raw), found

    amount, due, issue = picked("total_due", "amounts", "value"), picked("due_date", "dates", "iso"), picked("issue_date", "dates", "iso")
    category = F.col("choice.category")
    three = lambda name, x: {name: x[0], f"{name}_raw": x[1], f"{name}_confident": x[2]}
    record = {
        "id": stable_id(F.col("source")), "is_bill": F.lit(True), "vendor": F.coalesce(F.nullif(strip(F.coalesce("choice.vendor", F.lit(""))), F.lit("")), F.lit("Unknown")),
        "category": F.when(category.isin(CATEGORIES), category).otherwise("Other"), **three("amount", amount), **three("due_date", due), **three("issue_date", issue),
    }
    return once(rows.select("source", "amounts", "dates", "choice", *keep), **record).select("id", "source", *(k for k in record if k != "id"), *keep)


def pick_by_label(text: Column, candidates: Column) -> Column:
    """An offline stand-in for a model's choice: candidates that follow a label. It says nothing about a model's accuracy."""

    def after(labels: str, options: Column) -> Column:
        tail = F.regexp_extract(text, f"(?is)(?:{labels})\\s*:?\\s*(.{{0,40}})", 1)
        return F.coalesce(F.get(F.filter(F.transform(options, lambda c: c["raw"]), lambda r: F.startswith(tail, r)), F.lit(0)), F.lit(""))

    line = lambda label: F.regexp_extract(text, f"(?im)^{label}:[ \\t]*(.*)$", 1)
    return F.struct(
        F.lit(True).alias("is_bill"), line("from").alias("vendor"), line("category").alias("category"), after("amount due|balance due|total due", candidates["amounts"]).alias("total_due"),
        after("payment due date|due date|payment due", candidates["dates"]).alias("due_date"), after("invoice date|issue date|statement date", candidates["dates"]).alias("issue_date"),
    )


def extract(documents: DataFrame, pivot: int = 2025) -> DataFrame:
    """Records of the documents that look like bills, chosen by the offline stand-in. Texts without words are left out."""
    rows = with_candidates(documents.where(strip(F.coalesce("text", F.lit(""))) != ""), pivot).where("bill_like")
    return validated(once(rows, choice=pick_by_label(F.col("text"), F.struct("amounts", "dates"))).where("choice.is_bill"))


def _total(amount: Column) -> Column:
    """A sum exact to the cent; with amounts too large for that, or none at all (not a number), the sum of doubles."""
    exact = amount.try_cast("decimal(38,2)")
    return F.when(F.count_if(amount.isNotNull() & exact.isNull()) == 0, F.try_sum(exact).cast("double")).otherwise(F.sum(amount))


def category_totals(bills: DataFrame) -> DataFrame:
    """(category, total): signed amounts by category; categories without any amount are left out."""
    rows = bills.where("is_bill and amount is not null")
    total = _total(F.col("amount"))
    return rows.groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit("Other")).alias("category")).agg(total.alias("total"))


def _due(bills: DataFrame) -> tuple[DataFrame, Column]:
    day = F.try_to_date("due_date", "yyyy-MM-dd")
    return bills.where("is_bill"), day


def upcoming(bills: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    """Bills due from the day on and within the window, both ends in."""
    rows, day = _due(bills)
    last = F.date_add(F.lit(as_of).cast("date"), SETTINGS.forecast_days if days is None else days)
    return rows.where(day.between(F.lit(as_of).cast("date"), last))


def past_due(bills: DataFrame, as_of: str) -> DataFrame:
    rows, day = _due(bills)
    return rows.where(day < F.lit(as_of).cast("date"))


def due_totals(bills: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    """(state, total, bills) of upcoming and past-due bills. A null amount adds nothing but counts."""
    rows, day = _due(bills)
    first = F.lit(as_of).cast("date")
    state = F.when(day < first, "past_due").when(day <= F.date_add(first, SETTINGS.forecast_days if days is None else days), "upcoming")
    each = rows.withColumn("state", state).where("state is not null").groupBy("state")
    return each.agg(_total(F.coalesce(F.col("amount"), F.lit(0.0))).alias("total"), F.count("*").alias("bills"))


def by_due_date(bills: DataFrame) -> DataFrame:
    """The bills by due date, those without one last. They are stored first: a sort samples its input before it reads it, and would extract them twice."""
    return stored(bills).orderBy(F.col("due_date").asc_nulls_last(), "id")


def patch(bills: DataFrame, patches: DataFrame) -> DataFrame:
    """Bills with edits. patches: id and a JSON object text, changes, at most one row for an id.

    All fields of an edit are checked first; an edit with a wrong field changes nothing. A date of '' or null is taken away.
    Raw texts are kept as they were."""
    fields = F.from_json("changes", "map<string,string>")
    has = lambda k: F.coalesce(F.map_contains_key("__set", k), F.lit(False))
    new = lambda k: F.try_element_at("__set", F.lit(k))
    number = new("amount").try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    good_date = lambda k: ~has(k) | (F.coalesce(new(k), F.lit("")) == "") | (new(k).rlike("^\\d{4}-\\d{2}-\\d{2}$") & F.try_to_date(new(k), "yyyy-MM-dd").isNotNull())
    valid = (~has("amount") | finite) & (~has("category") | F.coalesce(new("category").isin(CATEGORIES), F.lit(False))) & good_date("due_date") & good_date("issue_date")
    rows = bills.join(patches.select("id", fields.alias("__set")), "id", "left").withColumn("__set", F.when(valid, F.col("__set")))
    edits = {
        "amount": F.when(has("amount"), number).otherwise(F.col("amount")), "amount_confident": F.when(has("amount"), True).otherwise(F.col("amount_confident")),
        "category": F.when(has("category"), new("category")).otherwise(F.col("category")),
        "vendor": F.when(has("vendor"), F.coalesce(F.nullif(strip(F.coalesce(new("vendor"), F.lit("None"))), F.lit("")), F.lit("Unknown"))).otherwise(F.col("vendor")),
    }
    for k in ("due_date", "issue_date"):
        edits[k] = F.when(has(k), F.nullif(new(k), F.lit(""))).otherwise(F.col(k))
        edits[f"{k}_confident"] = F.when(has(k), F.coalesce(new(k), F.lit("")) != "").otherwise(F.col(f"{k}_confident"))
    return rows.withColumns(edits).select(*bills.columns)


def delete(bills: DataFrame, ids: DataFrame) -> DataFrame:
    return bills.join(ids.select("id"), "id", "left_anti").select(*bills.columns)


def by_id(bills: DataFrame, ids: DataFrame) -> DataFrame:
    return bills.join(ids.select("id").distinct(), "id", "left_semi").select(*bills.columns)


def edit_stored(spark: SparkSession, path: str, patches: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
    """Edits a stored table of bills (``store.create``): patches as for ``patch``, then the ids that are deleted. Only the buckets of these ids are
    read and written; how many these are. Doing it twice changes nothing more."""
    none = spark.createDataFrame([], "id string")
    ids = (patches.select("id") if patches is not None else none).unionByName(deleted.select("id") if deleted is not None else none)

    def change(bills: DataFrame) -> DataFrame:
        bills = patch(bills, patches) if patches is not None else bills
        return delete(bills, deleted) if deleted is not None else bills

    return store.edit(spark, path, ids, change)
