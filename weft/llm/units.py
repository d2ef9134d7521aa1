"""Texts as units between spaces, with each batch's distinct units found by Arrow's hash tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Before a text's first unit, which has no space in front.
FIRST = "\x02"


def split(texts: pa.Array, forbidden: tuple[str, ...] = ()) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(plain, units, places, offsets): which texts are plain, their distinct units, and for the plain texts
    units[places[offsets[i]:offsets[i + 1]]].

    Plain texts are not empty, have single spaces and single line ends inside, no other white space or control characters, and nothing
    of `forbidden`, which has no white space. Their units: FIRST + word is the first; a unit with a line end in front is as it
    stands; any other stands for a space and the word. All of that shows in the distinct units, so texts are only cut.
    """
    spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " \n")
    lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(FIRST), spaced, ""), " ")
    coded = lists.flatten().dictionary_encode()
    words, places, offsets = coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    front = pc.or_(pc.starts_with(words, "\n"), pc.starts_with(words, FIRST))
    word = pc.if_else(front, pc.utf8_slice_codeunits(words, 1), words)
    good = pc.and_(pc.utf8_is_printable(word), pc.greater(pc.binary_length(word), 0))
    for x in forbidden:
        good = pc.and_not(good, pc.match_substring(word, x))
    good = good.to_numpy(zero_copy_only=False)
    if good.all():
        return np.ones(len(texts), bool), words.to_numpy(zero_copy_only=False).tolist(), places, offsets
    plain = np.logical_and.reduceat(good[places], offsets[:-1])
    n = np.diff(offsets)
    places = places[np.repeat(plain, n)]
    used = np.zeros(len(words), bool)
    used[places] = True
    at = np.cumsum(used) - 1
    return plain, words.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist(), at[places], np.append(0, np.cumsum(n[plain]))


def gather(values: list[bytes], places: np.ndarray, offsets: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of the values at places, one behind the other, and where each text's begin and end among them."""
    if not len(places):
        return pa.py_buffer(b""), np.zeros(len(offsets), np.int32)
    _, ends, data = pa.array(values, pa.binary()).take(pa.array(places)).buffers()
    ends = np.frombuffer(ends, np.int32)[: len(places) + 1]
    return data.slice(0, int(ends[-1])) if data is not None else pa.py_buffer(b""), ends[offsets]
