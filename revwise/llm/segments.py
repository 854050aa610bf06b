"""Texts as runs of few different segments, so that tokenizers see each segment once.

A text is cut in front of a blank (U+0020) that follows a character which is neither white
space nor U+2581 and that isn't the text's end.  A tokenizer whose pieces never hold such a place inside (a blank only
at their front, or as part of white space) gives a text the tokens of its segments,
one after the other, wherever the segments occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters beyond ``str.isspace`` that some tokenizers take for white space.
_MORE = "\u180e\u200b\u2060\ufeff\u2581"


@dataclass
class Cut:
    """Different segments, the segment numbers of all texts behind each other, and where each text's begin."""

    names: list[str]
    numbers: np.ndarray
    starts: np.ndarray


def open_ended(word: str) -> bool:
    """Whether a blank behind the word would not be cut off: it is empty or ends in white space."""
    last = word[-1:]
    return not last or last.isspace() or last in _MORE


def cut(texts: pa.Array, blank_first: bool = False) -> Cut:
    """Segments of each text (null: an empty text), with a blank in front of it if ``blank_first``.

    Every text has a segment; an empty one has the segment ``""`` (or a single blank).
    """
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
    starts = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    number = coded.indices.to_numpy().astype(np.int64)
    # A word that is empty or ends in white space keeps the next word in its segment.
    last = pc.utf8_slice_codeunits(coded.dictionary, start=-1, stop=None).dictionary_encode()
    blank = np.asarray([open_ended(c) for c in last.dictionary.to_pylist()], dtype=bool)
    open_end = blank[last.indices.to_numpy()]
    front = np.zeros(len(number), dtype=bool)
    front[starts[:-1]] = True
    begins = front.copy()
    begins[1:] |= ~open_end[number[:-1]]
    # A blank at the end is no segment of its own: a model that adds a blank sees nothing there.
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    ends = starts[1:] - 1
    begins[ends] &= ~empty[number[ends]] | front[ends]
    if blank_first:
        front[:] = False
    # Segments of one word: the word's number, words without a blank in front counted apart.
    keys = number + front * len(words)
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(number)))
    more: dict[str, int] = {}
    for i in np.flatnonzero(size > 1).tolist():
        run = " ".join([words[k] for k in number[at[i]:at[i] + size[i]].tolist()])
        name = run if front[at[i]] else " " + run
        keys[at[i]] = more.setdefault(name, 2 * len(words) + len(more))
    found = keys[at]
    used = np.zeros(2 * len(words) + len(more), dtype=bool)
    used[found] = True
    place = np.cumsum(used) - 1
    extra = list(more)
    names = [" " + words[k] if k < len(words) else words[k - len(words)] if k < 2 * len(words) else extra[k - 2 * len(words)]
             for k in np.flatnonzero(used).tolist()]
    return Cut(names, place[found], np.append(np.searchsorted(at, starts[:-1]), len(at)))


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indexes first[i], first[i] + 1, ... (``count[i]`` of them) for each i, behind each other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - count), count)


def byte_level_bytes() -> dict[str, int]:
    """Byte of each character that stands for it in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves; all others, in order, for U+0100 and up.
    """
    printable = {b for b in range(256) if chr(b).isprintable() and b != 0x20}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}
