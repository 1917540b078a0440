"""A model server's table of models as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def model_list(outputs: DataFrame, text: str = "output", by: tuple[str, ...] = ()) -> DataFrame:
    """(name, size) of the models in a command's white-space table, by name; of each host apart if ``by`` names columns of it. The head line is left out, a name has a colon, a size is
    the third and fourth column, and the last line of a name counts."""
    lines = outputs.select(*by, F.posexplode(F.split(F.btrim(F.col(text), F.lit(" \t\r\n")), "\n", -1)).alias("pos", "line")).where("pos > 0")
    parts = lines.select(*by, "pos", F.split(F.btrim("line", F.lit(" \t\r\n")), "\\s+", -1).alias("p")).where(F.contains(F.get("p", F.lit(0)), F.lit(":")))
    size = F.when(F.size("p") >= 4, F.concat_ws(" ", F.get("p", F.lit(2)), F.get("p", F.lit(3)))).otherwise("")
    return parts.groupBy(*by, F.get("p", F.lit(0)).alias("name")).agg(F.max_by(size, F.col("pos")).alias("size")).orderBy(*by, "name")
