"""Texts through a command, a process a text, in Arrow batches."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RAN = "struct<stdout:array<string>,stderr:array<string>,code:int>"


def run_one(command: list[str], text: str, seconds: float) -> tuple[list[str], list[str], int | None]:
    """Lines of both outputs and the exit code, null if the command took too long or couldn't be started."""
    try:
        done = subprocess.run(command, input=text.encode(), capture_output=True, timeout=seconds, check=False)
    except subprocess.TimeoutExpired:
        return [], [f"took over {seconds:g} seconds"], None
    except OSError as e:
        return [], [str(e)], None
    lines = lambda raw: raw.decode("utf-8", "replace").removesuffix("\n").split("\n") if raw else []
    return lines(done.stdout), lines(done.stderr), done.returncode


def piped(text: Column, command: list[str], seconds: float = 60) -> Column:
    """struct<stdout, stderr, code> of the command with the text as its input; null for null.  The command must be there on every executor."""

    @F.pandas_udf(RAN)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [run_one(command, t, seconds) if t is not None else (None, None, None) for t in texts]
        return pd.DataFrame(rows, columns=["stdout", "stderr", "code"])

    return F.when(text.isNotNull(), run(text))
