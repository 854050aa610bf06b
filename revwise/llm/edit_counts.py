"""Operator 10, edit-aware token counts with a segment tree of pre-tokens per document.

A text is cut into pre-tokens by the tokenizer's pattern; tokens never span two of them,
so a text's count is the sum over its pre-tokens.  Each document keeps a segment tree:
leaves hold runs of ``LEAF`` pre-tokens (their characters and tokens), inner nodes the
sums of their two children.

An edit replaces a range of characters.  The tree is descended by character sums to the
leaf that holds the range's start.  Pre-tokens depend only on what follows them (the
pattern matches from left to right and looks ahead, never back), so encoding begins one
leaf earlier, at a known border, and goes on leaf by leaf behind the range until a new
border meets an old one; from there on nothing changes.  Only this stretch is encoded
again, its leaves are rewritten in place, and the sums above them updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwise.llm.common import fresh, slices

LEAF = 16
#: Pre-tokens whose counts a task remembers.
CACHED = 500_000


class PieceCounts(dict):
    """Tokens of each pre-token, remembered up to ``CACHED`` of them."""

    def __init__(self, ranks: str, pattern: str) -> None:
        super().__init__()
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("count", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        n = self[piece] = len(self.bpe.encode_ordinary(piece))
        return n


class SegmentTree:
    """Characters and tokens of a text's leaves with their sums; node k has children 2k and 2k + 1."""

    def __init__(self, text: str, counts: PieceCounts) -> None:
        self.counts = counts
        self.text = text
        found = counts.pattern.findall(text)
        leaves = [found[at:at + LEAF] for at in range(0, len(found), LEAF)] or [[]]
        self.width = 1 << (len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.leaves = len(leaves)
        self.encoded = len(found)  # pre-tokens encoded so far, the first time included
        for k, leaf in enumerate(leaves):
            self._set(k, leaf)
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _set(self, leaf: int, pieces: list[str]) -> None:
        self.chars[self.width + leaf] = sum(map(len, pieces))
        self.tokens[self.width + leaf] = sum(map(self.counts.__getitem__, pieces))

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf with characters at the text's end), and its start."""
        node, start = 1, 0
        at = min(at, max(0, self.chars[1] - 1))
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def replace(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at`` on; places beyond the text mean its end."""
        at = min(max(at, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - at)
        first, start = self.find(at)
        steps = 2 if at == start else 1  # a border at the edit itself may move as well
        while steps and first > 0:  # boundary context: the leaf before
            first -= 1
            start -= self.chars[self.width + first]
            steps -= self.chars[self.width + first] > 0
        last, last_start = self.find(at + removed)
        end = last_start + self.chars[self.width + last]
        shift = len(inserted) - removed
        self.text = self.text[:at] + inserted + self.text[at + removed:]
        pieces, at_new = [], start
        matches = self.counts.pattern.finditer(self.text, start)
        while True:
            # Encode up to the old border behind the leaf; go on by a leaf while it is no border now.
            goal = end + shift
            if at_new < goal:
                m = next(matches, None)
                if m is None:
                    break
                pieces.append(m[0])
                at_new = m.end()
            elif at_new == goal and goal >= at + len(inserted) and goal > start:
                break
            elif last + 1 < self.leaves:
                last += 1
                end += self.chars[self.width + last]
            else:
                m = next(matches, None)
                if m is None:
                    break
                pieces.append(m[0])
                at_new = m.end()
        self.encoded += len(pieces)
        self._rewrite(first, last, pieces)

    def _rewrite(self, first: int, last: int, pieces: list[str]) -> None:
        """Spread the pieces evenly over the leaves they replace, then update the sums above."""
        n = last - first + 1
        for k in range(n):
            self._set(first + k, pieces[k * len(pieces) // n:(k + 1) * len(pieces) // n])
        lo, hi = (self.width + first) // 2, (self.width + last) // 2
        while lo:
            for node in range(lo, hi + 1):
                self._sum(node)
            lo, hi = lo // 2, hi // 2


COLUMNS = ["n_edits", "tokens_before", "tokens_after", "chars_after", "pretokens", "encoded_again"]


def count_edited(docs: DataFrame, ranks: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """``docs`` with its texts edited and the token counts before and after.

    ``edits`` is an array of (at, removed, inserted), applied one after the other: ``removed``
    characters from ``at`` on give way to ``inserted``.  Places beyond the text mean its end;
    null parts of an edit mean 0, 0 and an empty string; a null array or edit changes
    nothing.  A null text is an empty one.  Columns added (those named alike are replaced):
    n_edits, tokens_before, tokens_after, chars_after, pretokens (of the text before) and
    encoded_again (pre-tokens that the edits made it encode).  ``text`` holds the new text,
    ``edits`` is left out.  Every row is answered on its own, so repeated rows get equal
    answers and an empty table an empty result.
    """
    keep = [c for c in docs.columns if c not in (text, edits, *COLUMNS)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    edit, = fresh(keep, "edits")
    body, = fresh([*keep, edit], "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(body),
                       F.col(f"`{edits}`").cast("array<struct<at:long,removed:long,inserted:string>>").alias(edit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(ranks, pattern)
        for part in slices(batches, body):
            new, numbers = [], []
            for t, todo in zip(part.column(body).to_pylist(), part.column(edit).to_pylist(), strict=True):
                tree = SegmentTree(t or "", counts)
                before, first = tree.total(), tree.encoded
                todo = [e for e in todo or [] if e is not None]
                for e in todo:
                    tree.replace(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                new.append(tree.text)
                numbers.append((len(todo), before, tree.total(), len(tree.text), first, tree.encoded - first))
            yield pa.RecordBatch.from_arrays(
                [*part.select(keep).columns, pa.array(new, pa.string()),
                 *[pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)]], [*keep, text, *COLUMNS])
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{text}` string"] + [f"`{c}` long" for c in COLUMNS])
    return rows.mapInArrow(run, schema)
