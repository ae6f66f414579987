"""Maps from pairs in which a key may come again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_wins(pairs: Column) -> Column:
    """An array of structs of key and value as a map: of a key that comes again the last counts, pairs without a key are left out."""
    there = F.filter(pairs, lambda p: p["key"].isNotNull())

    def of(keyed: Column) -> Column:
        keys = F.transform(keyed, lambda p: p["key"])
        return F.map_from_entries(F.filter(keyed, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), p["key"]) == 0))

    return F.get(F.transform(F.array(there), of), F.lit(0))


def deduped(m: Column) -> Column:
    """A map as JSON gives it, which may hold a key twice, with the last of each."""
    return last_wins(F.map_entries(m))
