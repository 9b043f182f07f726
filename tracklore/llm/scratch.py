"""Deleting intermediate tables that nothing reads any more."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dispose(*tables: DataFrame) -> None:
    """Delete staged tables (session.stage) whose every use has itself been staged.

    Later tables don't need them, so a lost executor is served by what came after.
    """
    for table in tables:
        for file in table.inputFiles()[:1]:
            jvm = table.sparkSession._jvm
            home = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent().getParent()
            if not home.getName().startswith("tracklore-"):
                raise ValueError(f"{home} is not a staged table")
            home.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(home, True)
