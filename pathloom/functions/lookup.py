"""Looking terms up in a short word list, inside the tasks that hold the terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass(frozen=True)
class KnownTerms:
    """The terms of one Arrow batch that are in a word list, row after row.

    ``rows``: the batch rows that have any; ``starts``: where the terms of each begin; ``row_of``: per term, its place
    in ``rows``; ``word_at``: per term, its place in the word list; ``found``: which of all terms these are.
    """

    rows: np.ndarray
    starts: np.ndarray
    row_of: np.ndarray
    word_at: np.ndarray
    found: pa.Array

    def regroup(self, values: pa.Array) -> pa.ListArray:
        """One list per row of one value per known term."""
        return pa.ListArray.from_arrays(np.append(self.starts, len(self.word_at)).astype(np.int32), values)


def known_terms(lists: pa.ListArray, places: dict[str, int]) -> KnownTerms:
    """Find the terms of a batch among ``places``, each word's place in the list. Only the distinct terms of the batch
    are looked up, so the cost does not depend on the length of the list."""
    encoded = lists.flatten().dictionary_encode()
    distinct = [places.get(word, -1) for word in encoded.dictionary.to_pylist()]
    # The entry behind the last one is for null terms.
    at = np.array([*distinct, -1])[encoded.indices.fill_null(len(distinct)).to_numpy()]
    found = at >= 0
    lengths = lists.value_lengths().fill_null(0).to_numpy()
    owner = np.repeat(np.arange(len(lists)), lengths)[found]
    is_first = np.diff(owner, prepend=-1) > 0
    starts = np.flatnonzero(is_first)
    return KnownTerms(owner[starts], starts, np.cumsum(is_first) - 1, at[found], pa.array(found))
