"""Order-dependent rules as a stream over sorted partitions.

Rows of one key arrive together and in order; only the running state of the
current key is held, never its rows. Spark does the shuffle and the sort (which
spills), Python decides one row at a time from a small state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

import foliant

# Executors need not have this package installed: its few fold functions travel with the job.
cloudpickle.register_pickle_by_value(foliant)

_FLUSH = 10_000


def ordered_fold(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], object],
    step: Callable[[object, tuple], Iterable[tuple]],
    schema: str,
    finish: Callable[[tuple, object], Iterable[tuple]] | None = None,
) -> DataFrame:
    """Run ``step(state, row)`` over each key's rows in ``order``; emit what it yields.

    ``finish(key, state)`` may emit more when a key ends. Columns reach ``step``
    as a named tuple.
    """
    key_names, names = list(keys), [c.split()[0].split(":")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, out = None, None, []
        for batch in batches:
            for row in batch.itertuples(index=False, name="Row"):
                key = tuple(getattr(row, k) for k in key_names)
                if key != current:
                    if current is not None and finish is not None:
                        out.extend(finish(current, state))
                    current, state = key, start()
                out.extend(step(state, row))
                if len(out) >= _FLUSH:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if current is not None and finish is not None:
            out.extend(finish(current, state))
        if out:
            yield pd.DataFrame(out, columns=names)

    ordered = rows.repartition(*key_names).sortWithinPartitions(*key_names, *order)
    return ordered.mapInPandas(run, schema)
