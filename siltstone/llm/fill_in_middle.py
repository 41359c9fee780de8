"""Fill-in-the-middle: a document is cut twice and its middle moved to the end, behind marks.

Cuts fall between units, a run of the letters A-Z and a-z or any other single code point. The text is seen in
fixed blocks of code points; a Fenwick tree over the blocks holds how many units begin in each and how many code
points it has. A cut after k units is found by a binary-lifting descent of the tree to the block in which unit
k + 1 begins, and in that block alone by looking at its letters. So a long text is scanned once, in blocks, and
what is kept of it are two numbers a block.

Which documents are cut, where and in which order of parts follows from hashes of the identifier alone, so runs
agree on any number of executors, and a document without an identifier is cut as one with an empty identifier.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import released

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Code points of a block.
BLOCK = 4096


@dataclass(frozen=True, slots=True)
class Plan:
    """Of 100 documents so many are cut, and of 100 cut ones so many put the suffix first."""

    cut: int = 90
    suffix_first: int = 20
    seed: str = "1"


def _unit_starts(block: str, after_letter: bool) -> tuple[np.ndarray, bool]:
    """Whether a unit begins at each code point of a block, and whether the block ends in a letter."""
    points = np.frombuffer(block.encode("utf-32-le"), dtype=np.uint32)
    lower = points | 32
    letter = (lower >= 97) & (lower <= 122)
    starts = ~letter
    starts[1:] |= ~letter[:-1]
    starts[0] |= not after_letter
    return starts, bool(letter[-1])


class Blocks:
    """A Fenwick tree over the blocks of a text: of each block the units that begin in it and its code points."""

    def __init__(self, text: str, size: int = BLOCK) -> None:
        self.text, self.size, self.count = text, size, -(-len(text) // size)
        self.units = [0] * (self.count + 1)
        self.points = [0] * (self.count + 1)
        self.total, letter = 0, False
        for b in range(self.count):
            block = text[b * size : (b + 1) * size]
            starts, letter = _unit_starts(block, letter)
            self._add(b + 1, int(np.count_nonzero(starts)), len(block))
        self.top = 1 << max(0, self.count.bit_length() - 1)

    def _add(self, b: int, units: int, points: int) -> None:
        self.total += units
        while b <= self.count:
            self.units[b] += units
            self.points[b] += points
            b += b & -b

    def end_of(self, k: int) -> int:
        """The code points before unit k + 1, which are those of the first k units; all of them if there is none."""
        if k >= self.total:
            return len(self.text)
        b = points = 0
        left, step = k, self.top
        while step:  # the last block before which at most k units begin
            if b + step <= self.count and self.units[b + step] <= left:
                b += step
                left -= self.units[b]
                points += self.points[b]
            step >>= 1
        before = self.text[points - 1] if points else ""
        starts, _ = _unit_starts(self.text[points : points + self.size], before.isascii() and before.isalpha())
        return points + int(np.flatnonzero(starts)[left])


def is_whole(text: str) -> bool:
    """Whether a text is never cut: it is empty, or a mark in it would make the parts ambiguous."""
    return not text or PREFIX in text or SUFFIX in text or MIDDLE in text


def arranged(text: str, hashes: tuple[int, int, int, int], plan: Plan) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the text in that form."""
    blocks = Blocks(text)
    h1, h2, h3, h4 = hashes
    if is_whole(text) or h3 % 100 >= plan.cut:
        return blocks.total, "plain", None, None, text
    a, b = sorted((h1 % (blocks.total + 1), h2 % (blocks.total + 1)))
    x, y = blocks.end_of(a), blocks.end_of(b)
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if h4 % 100 < plan.suffix_first:
        return blocks.total, "spm", x, y - x, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return blocks.total, "psm", x, y - x, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def hashed(key: Column, seed: str) -> list[Column]:
    """The first four groups of eight digits of the SHA-256 of seed, colon and key, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points,
    null if plain) and output, the text in its form.

    A null text is an empty one, which stays plain; so does a text that contains a mark. A null identifier is
    hashed as an empty one. Repeated rows come out alike, each its own row. Texts of any length are cut whole. No
    rows give none; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            keys = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            rows = [arranged(text.as_py(), h, plan) for text, h in zip(batch.column(1), keys, strict=True)]
            n, form, prefix, middle, output = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string())]
            arrays += [pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *hashed(docs[id_col], plan.seed))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _parts(output: Column, second: str) -> tuple[Column, Column, Column]:
    """The parts of an output whose first mark is gone: up to the mark `second`, up to the last mark, and the rest."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    one = F.substring_index(body, second, 1)
    rest = F.substr(body, F.length(one) + len(second) + 1)
    two = F.substring_index(rest, MIDDLE, 1)
    return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form alone. No part holds a mark and no mark overlaps another, so the first mark
    of each kind is the one that was set."""
    prefix, suffix, middle = _parts(output, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = _parts(output, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
