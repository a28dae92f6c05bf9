"""Append-oriented tables on Spark: declared columns, Hive layouts, journalled commits, cached views."""

from .context import Context, ContextBuilder, ContextWriter
from .operators.builder import TableBuilder
from .operators.commit import StagedPart, TableWriter, WriterOptions
from .plans.partitioning import DictionaryPartition, MonoPartition, RowLenPartition, TimePartition
from .schema import Column, Schema
from .table import Table
from .transform import Transform
from .types import TypeHints

__all__ = [
    "Column", "Context", "ContextBuilder", "ContextWriter", "DictionaryPartition", "MonoPartition", "RowLenPartition", "Schema", "StagedPart", "Table", "TableBuilder", "TableWriter", "TimePartition", "Transform",
    "TypeHints", "WriterOptions",
]
