"""Byte-level BPE encoding and decoding through a pair occurrence index.

A task takes its documents in slices of bounded size. The distinct pieces of a slice lie end to end
in one array of symbols with links to the next and previous one. An index maps every mergeable pair,
by its rank, to all its positions. The active ranks are applied in ascending order; a merge at all
positions of a rank makes new pairs to its left and right, whose positions join their ranks' lists.
Within a piece this is the order of the usual greedy rule, lowest rank first, leftmost first.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import released

#: Fixed value: the pattern that splits text before merging in byte-level BPE; \s is Unicode white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Bytes of text that one pair index covers.
SLICE_CHARS = 2 << 20

#: A rank with up to so many positions is merged one by one, beyond it as a vector.
FEW = 12


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others take the characters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        stand_in = byte_characters()
        byte_of = {c: b for b, c in enumerate(stand_in)}
        tokens = [b""] * size
        for token, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.byte_ids = np.array([ids[c] for c in stand_in], dtype=np.int32)
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.size = size
        codes = self.left * size + self.right
        self.by_code = np.argsort(codes, kind="stable")
        self.codes = codes[self.by_code]
        self.rank_of = dict(zip(codes.tolist(), range(len(codes)), strict=True))
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.odd_space = regex.compile(r" (?=\p{White_Space}|$)")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it isn't mergeable."""
        code = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.by_code[at], -1)

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, end to end, and the number of ids of each."""
        raw = list(map(str.encode, pieces))
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbol = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        n, ends = len(symbol), np.cumsum(lengths)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        here = np.flatnonzero(after >= 0)
        rank = self.ranks(symbol[here], symbol[here + 1])
        here, rank = here[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        here, rank = here[order], rank[order]
        firsts = np.flatnonzero(np.diff(rank, prepend=-1))
        index: dict[int, list] = {int(r): [a] for r, a in zip(rank[firsts], np.split(here, firsts[1:]), strict=True)} if len(here) else {}
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r, None)
            if not lists:
                continue
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            left, right, new = int(self.left[r]), int(self.right[r]), int(self.merged[r])
            if len(at) <= FEW or left == right:
                added = self._merge_each(at.tolist(), left, right, new, symbol, after, before)
            else:
                added = self._merge_all(at, left, right, new, symbol, after, before)
            for rank_, where in added:
                if rank_ in index:
                    index[rank_].append(where)
                else:
                    index[rank_] = [where]
                    heapq.heappush(active, rank_)
        alive = symbol >= 0
        counts = np.add.reduceat(alive, ends - lengths) if n else np.zeros(0)
        return symbol[alive], counts.astype(np.int64)

    def _merge_each(self, at: list[int], left: int, right: int, new: int, symbol, after, before) -> list[tuple[int, np.ndarray]]:
        found: dict[int, list[int]] = {}
        get, size = self.rank_of.get, self.size
        for i in at:
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue
            k, p = after[j], before[i]
            symbol[i], symbol[j], after[i] = new, -1, k
            if k >= 0:
                before[k] = i
                if (r := get(new * size + int(symbol[k]))) is not None:
                    found.setdefault(r, []).append(i)
            if p >= 0 and (r := get(int(symbol[p]) * size + new)) is not None:
                found.setdefault(r, []).append(int(p))
        return [(r, np.array(x)) for r, x in found.items()]

    def _merge_all(self, at: np.ndarray, left: int, right: int, new: int, symbol, after, before) -> list[tuple[int, np.ndarray]]:
        j = after[at]
        good = (symbol[at] == left) & (j >= 0)
        good &= symbol[np.maximum(j, 0)] == right
        at, j = at[good], j[good]
        symbol[at], symbol[j] = new, -1
        k = after[j]
        after[at] = k
        before[k[k >= 0]] = at[k >= 0]
        p, here = before[at], at[k >= 0]
        p = p[p >= 0]
        where = np.concatenate([p, here])
        rank = self.ranks(symbol[where], symbol[after[where]])
        where, rank = where[rank >= 0], rank[rank >= 0]
        if not len(rank):
            return []
        order = np.argsort(rank, kind="stable")
        where, rank = where[order], rank[order]
        firsts = np.flatnonzero(np.diff(rank, prepend=-1))
        return list(zip(rank[firsts].tolist(), np.split(where, firsts[1:]), strict=True))

    def chunks(self, text: str) -> list[str]:
        """The text cut where the split pattern always cuts. A space before anything but white space
        always begins a piece; such a chunk lacks that space and is marked by its absence. Chunks that
        begin the text or follow a special token carry a leading NUL, special tokens two."""
        parts: Iterable[str] = self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else (text,)
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append("\0\0" + part)
            elif not part:
                continue
            elif "\0" in part or self.odd_space.search(part):
                out.extend("\0" + p for p in self.split.findall(part))
            else:
                first, *rest = part.split(" ")
                if first:
                    out.append("\0" + first)
                out += rest
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the number of ids of each text."""
        cut = [self.chunks(t) for t in texts]
        sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        distinct = list(dict.fromkeys(chain.from_iterable(cut)))
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        plain = [" " + c for c in distinct if c.isalpha()]  # each is one piece
        pieces: dict[str, int] = dict(zip(plain, range(len(plain)), strict=True))
        piece, members, counts, next_plain = pieces.setdefault, [], [], 0
        for chunk in distinct:
            if chunk.isalpha():
                members.append(next_plain)
                counts.append(1)
                next_plain += 1
            elif chunk[:-1].isalpha() and chunk[-1] in ".,":
                members += (piece(" " + chunk[:-1], len(pieces)), piece(chunk[-1], len(pieces)))
                counts.append(2)
            elif chunk[:2] == "\0\0" and chunk[2:] in self.special:
                members.append(-1 - self.special[chunk[2:]])
                counts.append(1)
            else:
                found = self.split.findall(chunk[1:] if chunk[:1] == "\0" else " " + chunk)
                counts.append(len(found))
                members += [piece(p, len(pieces)) for p in found]
        ids, lengths = self.merge(list(pieces))
        base = len(lengths)
        member = np.array(members, dtype=np.int64)
        special = np.flatnonzero(member < 0)  # special tokens are pieces of one id
        ids, lengths = np.concatenate([ids, -1 - member[special]]), np.concatenate([lengths, np.ones(len(special), dtype=np.int64)])
        member[special] = base + np.arange(len(special))
        starts = np.cumsum(lengths) - lengths
        chunk_ids, chunk_lengths = _gather(ids, starts[member], lengths[member]), _sums(lengths[member], np.array(counts, dtype=np.int64))
        chunk_starts = np.cumsum(chunk_lengths) - chunk_lengths
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(sizes.sum()))
        return _gather(chunk_ids, chunk_starts[which], chunk_lengths[which]).astype(np.int32), _sums(chunk_lengths[which], sizes)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        raw = _gather(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()
        ends = np.cumsum(_sums(self.lengths[ids], counts)).tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends, strict=False)]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, of the given lengths, which may be 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return (total[ends] - total[ends - counts]).astype(np.int64)


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], end to end."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    return values[np.arange(n) + np.repeat(starts - (ends - lengths), lengths)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows of up to `most` bytes together; a longer row stands alone."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs in `keep` (default: all but the text) and the token ids of the whole text.

    Special tokens in a text become their ids; none are added. A null text is an empty one; an empty
    text has no ids. A kept column named like `ids_col` gives way to the ids. Rows may repeat. A text longer than
    a slice has one of its own. Run it in shared.small_batches() where texts are long.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, ids_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for batch in batches:
            texts = batch.column(len(kept))
            for a, b in slices(pc.binary_length(texts).to_pylist(), SLICE_CHARS):
                ids, counts = v.encode(texts.slice(a, b - a).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[*kept, ids_col])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.select(*kept, F.coalesce(docs[text_col], F.lit("")).alias(text_col)).mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """decode(encode(docs)) in one pass through Python: the columns in `keep`, ids and decoded. The text comes
    from the ids alone."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for batch in released(batches):
            texts = batch.column(len(kept))
            for a, b in slices(pc.binary_length(texts).to_pylist(), SLICE_CHARS):
                ids, counts = v.encode(texts.slice(a, b - a).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                decoded = pa.array(v.decode(ids, counts), type=pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), pa.ListArray.from_arrays(offsets, pa.array(ids)), decoded], names=[*kept, "ids", "decoded"])

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(*kept, F.coalesce(docs[text_col], F.lit("")).alias(text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids, special tokens included; bytes that are not UTF-8 become
    U+FFFD. Null or no ids give an empty text."""
    kept = [c for c in encoded.columns if c != text_col]
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for batch in batches:
            column = batch.column(at)
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices((counts * 4).tolist(), SLICE_CHARS):
                ids = column.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                texts = pa.array(v.decode(ids, counts[a:b]), type=pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), texts], names=[*kept, text_col])

    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField(text_col, T.StringType())])
    return encoded.select(*kept).mapInArrow(run, schema)
