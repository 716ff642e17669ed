"""Helpers shared by the training-data operators."""

from pyspark.sql import DataFrame

from fieldloom.operators.components import connected_components
from fieldloom.plans.scratch import Queries, Scratch, columns_only, delete_path, scratch_path, table


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


__all__ = ["Queries", "Scratch", "columns_only", "connected_components", "delete_path", "free_name", "scratch_path", "table"]
