"""The built-in embedder: signed hashing of tokens, deterministic and offline. A model-backed one takes its place as a pandas UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.text import tokenize

DIMENSION = 64


def hashed(text: Column, dimension: int = DIMENSION) -> Column:
    """Counts of tokens by hash cell, with a sign by another hash bit; a text's tokens are hashed once. A null text has no vector."""
    cells = F.transform(tokenize(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % F.lit(2 * dimension)).cast("int"))

    # Sorted among one mark for each cell, a cell's tokens lie between two marks: no pass over the tokens by a lambda for each place.
    marks = F.sequence(F.lit(0), F.lit(2 * dimension))
    once = lambda c, use: F.element_at(F.transform(F.array(c), use), 1)  # noqa: E731  a lambda's variable is worked out once
    held = lambda at, k: F.element_at(at, k + 2) - F.element_at(at, k + 1)
    placed = lambda own: F.transform(marks, lambda k: F.array_position(own, k).cast("int"))
    signed = lambda at: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: (held(at, k) - held(at, k + dimension)).cast("double"))
    return F.when(text.isNotNull(), once(F.sort_array(F.concat(cells, marks)), lambda own: once(placed(own), signed)))
