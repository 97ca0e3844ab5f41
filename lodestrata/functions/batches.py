"""Rows of a batch in runs of so many characters, so that what Python makes of texts is held for one run at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Characters of the texts of a run, about; one text may be longer.
RUN_CHARS = 250_000


def runs(texts: pd.Series, chars: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows with about ``chars`` characters; a batch is rows, whose texts may be of any length."""
    if len(texts):
        size = np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts]) // chars
        cuts = (np.flatnonzero(np.diff(size)) + 1).tolist()
        yield from zip([0, *cuts], [*cuts, len(texts)], strict=True)


def text_udf(make: Callable[[pd.Series], pd.Series], kind):
    """A pandas UDF over one column of texts that hands on what ``make`` gives for a run before it begins the next."""
    chars = RUN_CHARS

    def by_run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if not len(texts):
                yield make(texts)
            for a, b in runs(texts, chars):
                yield make(texts.iloc[a:b])

    return F.pandas_udf(by_run, kind)
