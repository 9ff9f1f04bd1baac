"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from there: its plan is done once and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Pick and rename the columns that an operator works on, so that extra columns of any name can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def worker_state(key: str, make: Callable[[], Any]) -> Any:
    """A value kept by a Python worker from one task to the next, such as a loaded tokenizer."""
    name = "_millrace_llm_worker"
    module = sys.modules.setdefault(name, ModuleType(name))
    if not hasattr(module, key):
        setattr(module, key, make())
    return getattr(module, key)
