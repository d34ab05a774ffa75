"""Every operator as a query over the given tables, with equivalent SQL.

Queries read whole tables; their matrices, vectors and series are defined in
``tables``.
"""

from . import algebra, layouts, measures, ordered, texts
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "algebra", "layouts", "measures", "ordered", "texts"]
