"""Writing what is read more than once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def stored(table: DataFrame) -> DataFrame:
    """table, written to the folder in spark.checkpoint.dir, which the driver and all executors share: a lost executor takes nothing with it. Only a
    local session without such a folder gets a temporary one."""
    context = table.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return table.checkpoint()


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more; without this they stay until the application's folder is removed."""
    for table in tables:
        plan = table._jdf.logicalPlan()
        while plan.children().size():
            plan = plan.children().head()
        name = plan.rdd().getCheckpointFile()
        if name.isDefined():
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(name.get())
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
