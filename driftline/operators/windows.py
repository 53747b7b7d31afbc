"""Window specifications shared by all operators, and why they stay bounded.

``(SID, ISO_TIME)`` is unique on a 6-hour grid once duplicates and off-grid
rows are gone, so one key holds at most 4 rows per day of record: about 66,000
rows for 45 seasons, whatever the table size. A key with a third of the *raw*
rows can only consist of copies and off-grid rows; ``clean`` filters and
pre-aggregates those map-side (hash of SID and ISO_TIME) before the first of
these windows. ``by_segment`` names SID first on purpose: a table hashed by SID
satisfies it, so cleaning and features share one Exchange.

For finer cadences, where that bound is no comfort, the operators take
``tile_hours`` and cut each key into time tiles (module ``tiles``).
"""

from __future__ import annotations

from pyspark.sql import Window


def by_storm(tiled: bool = False):
    """Rows of a storm in time order; ``tiled`` adds the tile (see ``tiles``)."""
    return Window.partitionBy("SID", *(["TILE"] if tiled else [])).orderBy("ISO_TIME")


def by_segment(tiled: bool = False):
    return Window.partitionBy("SID", *(["TILE"] if tiled else []), "SEGMENT_ID").orderBy("ISO_TIME")


def whole_segment():
    return Window.partitionBy("SID", "SEGMENT_ID")
