"""Invoice texts made from orders, for queries over bills: what is read from a text can be held against its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import CATEGORIES
from ..functions.once import dealt

FORMATS = ["yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy"]


def invoices(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """(source, text): an invoice of each order, due 30 days after it. The date format goes round by the order's key."""
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "c_name")
    # An order has one customer. Each row costs some 0.4 ms of a core afterwards.
    rows = dealt(rows, orders.count())
    issued = F.to_date("o_orderdate")
    which = F.pmod("o_orderkey", F.lit(len(FORMATS))).cast("int")
    shown = lambda day: F.get(F.array(*(F.date_format(day, f) for f in FORMATS)), which)
    category = F.get(F.array(*map(F.lit, CATEGORIES)), F.pmod("o_custkey", F.lit(len(CATEGORIES))).cast("int"))
    text = F.concat(
        F.lit("Invoice "), F.col("o_orderkey").cast("string"), F.lit("\nFrom: "), "c_name", F.lit("\nCategory: "), category, F.lit("\nInvoice date: "), shown(issued),
        F.lit("\nPayment due date: "), shown(F.date_add(issued, 30)), F.lit("\nAmount due: $"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), F.lit("\nThank you.\n"),
    )
    return rows.select(F.concat(F.lit("invoices/"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("source"), text.alias("text"))
