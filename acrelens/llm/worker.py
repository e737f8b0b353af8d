"""The memory of Python workers: what they remember, and how much they work on at once.

Spark reuses its workers, so one may serve several operators in turn. Only the last
one's tables are held: what another operator remembered goes before they are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

#: Rows of whole texts that are worked on, and given back, at once.
ROWS = 512
_held: dict[tuple, Any] = {}


def remembered(key: tuple, make: Callable[[], Any]) -> Any:
    """The table of this worker under ``key``; made anew if another one is held."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Spark's batches, whose bytes the session bounds, ROWS at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
