"""Routing of logged command scripts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TOOL_MARKS = (" eval ", "pwd -P >|")
SNAPSHOT_SHELL = r"snapshot-(bash|zsh)-"
READER_VERBS = r"(?U)(?:^|[\s/'\"(;&|])%s['\"]?\s+(?:recall|search)(?=[\s'\"]|$)"
DEFAULT_SHELL = "/bin/sh"
# ----------------------------------------------------------------------------


def route_command(df: DataFrame, reader: str, col: str = "script") -> DataFrame:
    """Adds ``is_tool``, ``is_reader`` and ``shell``.

    A tool script carries both marks; a script that runs the archive's reader
    must never be pruned again; the shell is the one its snapshot file names.
    """
    c = F.col(col)
    tool = F.lit(True)
    for mark in TOOL_MARKS:
        tool = tool & c.contains(mark)
    named = F.regexp_extract(c, SNAPSHOT_SHELL, 1)
    return df.select(
        "*",
        tool.alias("is_tool"),
        c.rlike(READER_VERBS % re.escape(reader)).alias("is_reader"),
        F.when(named != "", named).otherwise(DEFAULT_SHELL).alias("shell"),
    )
