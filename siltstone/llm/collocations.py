"""Phrase collocation mining with counting quotient filters.

A phrase of up to five words counts only if all its parts do, so lengths are counted one after another: words first,
then phrases of two to five words whose two parts, without the last and without the first word, were frequent.
Frequent words get dense numbers within their language, and texts become sequences of these once, with a 0 where a
piece ends or a rare word stands.

The numbers of a phrase are packed into one integer of two halves, which four Feistel rounds permute invertibly. The
high bits of the permuted integer are the quotient and all others the remainder, so a filter is a lossless map from
phrases to counts: quotients are kept as a string of bits, a 1 for each remainder and a 0 at the end of each
quotient's run, remainders in as many bytes as they need, counts in one byte, or nine if they are large. Every task
counts into filters of its own, cut by ranges of the permuted integers; the filters of a range, which are sorted,
are merged in one task, and ranges are even, as the permutation scatters phrases alike. Beside the counts each
length gives a bitmap of the hashes of its frequent phrases, at most 16 MB whatever their number, from which the
next length sees what it need not count; what the bitmap lets through by chance falls to the exact counts.
"""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import checked_small, released, scratch, stage, staged_texts

U = np.uint64

#: Pieces of a text end at these characters; words are divided by blanks and tabs.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"

#: Bytes of text with piece ends as line feeds and tabs as blanks.
PLAIN = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")

#: Frequent words that a task may hold as a dictionary, and their bytes; beyond that texts meet them in a join.
VOCABULARY, VOCABULARY_BYTES = 400_000, 8 << 20

#: Words that a task counts before it hands them on; phrases that it sorts at once; entries of its filters.
WORDS_HELD, SORTED, ENTRIES = 300_000, 1 << 20, 1 << 21

#: Entries that the filters of one range should hold together, about; bits of the bitmap between lengths.
RANGE_ENTRIES, SIEVE_BITS = 2 << 20, 1 << 27

KEYS = np.random.default_rng(53).integers(0, 1 << 63, 5, dtype=np.uint64) << U(1) | U(1)


@dataclass(frozen=True, slots=True)
class Rules:
    """Phrases of 2 to `longest` words that occur `least` times or more; those go that lie inside a longer one with at
    least `inside` hundredths of their count; `top` phrases of each language."""

    least: int = 100
    longest: int = 5
    inside: int = 100
    top: int = 2000


def tokens(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, a line feed where a piece ends, and empty strings."""
    return text.lower().translate(PLAIN).replace(b"\n", b" \n ").split(b" ")


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def half_bits(order: int, bits: int) -> int:
    """Bits of each half of a packed phrase; the middle one of an odd number of words is divided."""
    return order // 2 * bits + order % 2 * (bits - bits // 2)


def _joined(words: np.ndarray, bits: int) -> np.ndarray:
    return reduce(lambda x, i: x << U(bits) | words[:, i].astype(np.uint64), range(words.shape[1]), np.zeros(len(words), dtype=np.uint64))


def packed(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the integers that rows of word numbers make."""
    half, odd = divmod(words.shape[1], 2)
    hi, lo = _joined(words[:, :half], bits), _joined(words[:, half + odd :], bits)
    if odd:
        low, middle = bits // 2, words[:, half].astype(np.uint64)
        hi = hi << U(bits - low) | middle >> U(low)
        lo |= (middle & U((1 << low) - 1)) << U(bits * half)
    return hi, lo


def unpacked(hi: np.ndarray, lo: np.ndarray, order: int, bits: int) -> np.ndarray:
    half, odd = divmod(order, 2)
    out, one = np.zeros((len(hi), order), dtype=np.int32), U((1 << bits) - 1)
    if odd:
        low = bits // 2
        out[:, half] = (hi & U((1 << bits - low) - 1)) << U(low) | lo >> U(bits * half)
        hi = hi >> U(bits - low)
    for i in range(half):
        out[:, half - 1 - i] = hi >> U(bits * i) & one
        out[:, order - 1 - i] = lo >> U(bits * i) & one
    return out


def permuted(hi: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Feistel rounds over two halves of `width` bits."""
    mask = U((1 << width) - 1)
    for key in KEYS[:4]:
        hi, lo = lo, hi ^ (scrambled(lo * key) & mask)
    return hi, lo


def unpermuted(hi: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U((1 << width) - 1)
    for key in KEYS[3::-1]:
        hi, lo = lo ^ (scrambled(hi * key) & mask), hi
    return hi, lo


def sieved(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A hash of permuted phrases for the bitmap, 62 bits."""
    return scrambled(hi * KEYS[4] + lo) >> U(2)


def _planes(x: np.ndarray, bits: int) -> bytes:
    """The low `bits` bits of numbers, a plane of bytes after another."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].T).tobytes()


def _from_planes(raw: bytes, at: int, m: int, bits: int) -> tuple[np.ndarray, int]:
    n = -(-bits // 8)
    wide = np.zeros((m, 8), dtype=np.uint8)
    wide[:, :n] = np.frombuffer(raw, dtype=np.uint8, count=m * n, offset=at).reshape(n, m).T
    return wide.view("<u8").reshape(-1), at + m * n


@dataclass(slots=True)
class QuotientFilter:
    """Counts of permuted phrases in two halves of `width` bits, sorted by them, each once. All of them agree in
    their first `prefix` bits, which are not stored."""

    hi: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    width: int

    @classmethod
    def counting(cls, hi: np.ndarray, lo: np.ndarray, n: np.ndarray, width: int) -> QuotientFilter:
        """Sum the counts of equal phrases. The sort is a merge of the runs that are sorted already."""
        if not len(hi):
            return cls(hi, lo, n, width)
        order = np.argsort(hi << U(width) | lo, kind="stable") if 2 * width <= 64 else np.lexsort((lo, hi))
        hi, lo, n = hi[order], lo[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        return cls(hi[first], lo[first], np.add.reduceat(n, first), width)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        if len(filters) == 1:
            return filters[0]
        return cls.counting(*(np.concatenate([getattr(f, c) for f in filters]) for c in ("hi", "lo", "n")), filters[0].width)

    def __len__(self) -> int:
        return len(self.hi)

    def cut(self, prefix: int) -> Iterator[tuple[int, QuotientFilter]]:
        """The parts of the filter by the first `prefix` bits."""
        top = (self.hi >> U(self.width - prefix)).astype(np.int64)
        at = np.searchsorted(top, np.arange((1 << prefix) + 1))
        for i in np.flatnonzero(at[1:] > at[:-1]):
            a, b = at[i], at[i + 1]
            yield int(i), QuotientFilter(self.hi[a:b], self.lo[a:b], self.n[a:b], self.width)

    def to_bytes(self, prefix: int) -> bytes:
        m = len(self)
        q = min(self.width - prefix, m.bit_length())
        rest = self.width - prefix - q
        quotient = (self.hi >> U(rest) & U((1 << q) - 1)).astype(np.int64)
        runs = np.zeros(m + (1 << q), dtype=bool)
        runs[np.arange(m) + quotient] = True
        large = self.n >= 255
        head = struct.pack("<QBBBQQ", m, q, self.width, prefix, int(self.hi[0] >> U(self.width - prefix)) if m else 0, int(large.sum()))
        small = np.where(large, 255, self.n).astype(np.uint8).tobytes()
        parts = [head, np.packbits(runs).tobytes(), _planes(self.hi & U((1 << rest) - 1), rest), _planes(self.lo, self.width)]
        return b"".join([*parts, small, self.n[large].astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        m, q, width, prefix, top, large = struct.unpack_from("<QBBBQQ", raw)
        at, rest = struct.calcsize("<QBBBQQ"), width - prefix - q
        bits = m + (1 << q)
        runs = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=-(-bits // 8), offset=at), count=bits)
        at += -(-bits // 8)
        quotient = np.flatnonzero(runs) - np.arange(m)
        hi, at = _from_planes(raw, at, m, rest)
        hi = hi | quotient.astype(np.uint64) << U(rest)
        if prefix:
            hi |= U(top) << U(width - prefix)
        lo, at = _from_planes(raw, at, m, width)
        n = np.frombuffer(raw, dtype=np.uint8, count=m, offset=at).astype(np.int64)
        n[n == 255] = np.frombuffer(raw, dtype="<i8", count=large, offset=at + m)
        return cls(hi, lo, n, width)


def _language(column: Column) -> Column:
    return F.coalesce(column, F.lit("und"))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(_language(docs[lang_col]).alias("lang"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)

    def given() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            for c in (b"", b"\n"):
                counts.pop(c, None)
            arrays = [pa.repeat(lang, len(counts)), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "n"])
        held.clear()

    for batch in released(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held[lang].update(tokens(text.as_py()))
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from given()
    yield from given()


def words(texts: DataFrame) -> DataFrame:
    """lang, word and n of all words, staged. Tasks count before anything is shuffled."""
    counts = texts.mapInArrow(_word_counts, "lang string, word binary, n long")
    return staged_texts(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrase-words")


def numbered(frequent: DataFrame) -> DataFrame:
    """The frequent words with a dense number within their language, from 1, in two levels: by slice of a hash, and
    within it."""
    slices = max(1, frequent.count() // 20_000)
    rows = frequent.withColumn("slice", F.pmod(F.xxhash64("word"), F.lit(slices)))
    sums = rows.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("lang").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("lang", "slice").orderBy("word")))
    rows = rows.join(sums.select("lang", "slice", before.alias("before")), ["lang", "slice"])
    return stage(rows.select("lang", "word", "n", (F.col("before") + F.col("place")).cast("int").alias("id")), "phrase-vocabulary")


def _sequences(rows: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    """Numbers of the texts of a batch, by language, each text closed by a 0."""
    by_lang: dict[str, list[np.ndarray]] = defaultdict(list)
    for lang, ids in rows:
        by_lang[lang] += [ids, np.zeros(1, dtype=np.int32)]
    joined = [np.concatenate(v) for v in by_lang.values()]
    narrow = [(x.astype(np.uint16) if x.max() < 1 << 16 else x).astype("<u2" if x.max() < 1 << 16 else "<i4") for x in joined]
    arrays = [pa.array(list(by_lang), pa.string()), pa.array([x.itemsize for x in narrow], pa.int32()), pa.array([x.tobytes() for x in narrow], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "bytes", "ids"])


def _coded(batches: Iterator[pa.RecordBatch], numbers) -> Iterator[pa.RecordBatch]:
    known = numbers.value
    for batch in released(batches):
        rows = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = map(known.get(lang, {}).get, filter(None, tokens(text.as_py())), repeat(0))
            rows.append((lang, np.fromiter(found, dtype=np.int32)))
        if rows:
            yield _sequences(rows)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        rows = [[w for w in tokens(text.as_py()) if w] for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.binary()))], names=["lang", "words"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        if batch.num_rows:
            yield _sequences(list(zip(batch.column(0).to_pylist(), (x.values.to_numpy() for x in batch.column(1)), strict=True)))


def coded(texts: DataFrame, vocabulary: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """lang, ids and the bytes of each: texts as numbers of frequent words, with a 0 where a phrase can't go on.

    Up to `most` words go to the tasks as a dictionary. Beyond that words are joined with their numbers and texts put
    together again, each from its own words.
    """
    spark, out = texts.sparkSession, "lang string, bytes int, ids binary"
    n, size = vocabulary.agg(F.count(F.lit(1)), F.sum(F.octet_length("word") + F.octet_length("lang"))).first()
    if n <= most and (size or 0) <= VOCABULARY_BYTES:
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        for row in vocabulary.collect():
            known[row.lang][bytes(row.word)] = row.id
        return staged_texts(texts.mapInArrow(partial(_coded, numbers=spark.sparkContext.broadcast(dict(known))), out), "phrase-texts")
    split = staged_texts(texts.mapInArrow(_split, "lang string, words array<binary>").withColumn("row", F.monotonically_increasing_id()), "phrase-split")
    each = split.select("row", "lang", F.posexplode("words").alias("place", "word"))
    each = each.join(vocabulary.select("lang", "word", "id"), ["lang", "word"], "left").select("row", "lang", F.struct("place", F.coalesce("id", F.lit(0)).alias("id")).alias("at"))
    ids = each.groupBy("row", "lang").agg(F.array_sort(F.collect_list("at"))["id"].alias("ids")).select("lang", "ids")
    return staged_texts(ids.mapInArrow(_gathered, out), "phrase-texts")


def _windows(ids: np.ndarray, order: int, bits: int, sieve: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The permuted phrases of `order` words in a sequence. With a sieve, those of which it holds both parts."""
    if len(ids) < order:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    whole = ids != 0
    run = reduce(np.logical_and, (whole[i : len(ids) - order + 1 + i] for i in range(order)))
    if sieve is not None and run.any():
        at = np.flatnonzero(run)
        near = np.union1d(at, at + 1)
        parts = permuted(*packed(np.lib.stride_tricks.sliding_window_view(ids, order - 1)[near], bits), half_bits(order - 1, bits))
        bit = sieved(*parts) & U(len(sieve) * 8 - 1)
        held = np.zeros(len(ids) + 1, dtype=bool)
        held[near] = sieve[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8) & 1
        run &= held[: len(run)] & held[1 : len(run) + 1]
    return permuted(*packed(np.lib.stride_tricks.sliding_window_view(ids, order)[run], bits), half_bits(order, bits))


def _filters(batches: Iterator[pa.RecordBatch], order: int, bits: int, prefix: int, sieve) -> Iterator[pa.RecordBatch]:
    """The phrases of a task's texts, counted in filters: lang, part (range), filter."""
    bitmap = None if sieve is None else np.frombuffer(sieve.value, dtype=np.uint8)
    width = half_bits(order, bits)
    raw: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    held: dict[str, list[QuotientFilter]] = defaultdict(list)

    def sort(lang: str) -> None:
        hi, lo = (np.concatenate(c) for c in zip(*raw.pop(lang), strict=True))
        held[lang].append(QuotientFilter.counting(hi, lo, np.ones(len(hi), dtype=np.int64), width))

    def given() -> Iterator[pa.RecordBatch]:
        for lang, filters in held.items():
            parts = [(i, f.to_bytes(prefix)) for i, f in QuotientFilter.merged(filters).cut(prefix)]
            arrays = [pa.repeat(lang, len(parts)), pa.array([i for i, _ in parts], pa.int32()), pa.array([f for _, f in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "part", "filter"])
        held.clear()

    for batch in released(batches):
        for lang, size, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            seen = np.frombuffer(ids.as_py(), dtype="<u2" if size == 2 else "<i4").astype(np.int32)
            raw[lang].append(_windows(seen, order, bits, bitmap))
            if sum(len(x[0]) for x in raw[lang]) > SORTED:
                sort(lang)
                if sum(len(f) for f in held[lang]) > 2 * ENTRIES:
                    held[lang] = [QuotientFilter.merged(held[lang])]
        if sum(len(f) for v in held.values() for f in v) > 3 * ENTRIES:
            yield from given()
    for lang in list(raw):
        sort(lang)
    yield from given()


def _merging(order: int, bits: int, least: int):
    width = half_bits(order, bits)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """The frequent phrases of the filters of one range, with the hashes that the bitmap keeps."""
        whole = QuotientFilter.merged([QuotientFilter.from_bytes(f.as_py()) for f in table["filter"]])
        often = whole.n >= least
        hi, lo = whole.hi[often], whole.lo[often]
        numbers = unpacked(*unpermuted(hi, lo, width), order, bits)
        ids = pa.ListArray.from_arrays(np.arange(len(hi) + 1, dtype=np.int32) * order, pa.array(numbers.reshape(-1), pa.int32()))
        arrays = [pa.repeat(key[0].as_py(), len(hi)), ids, pa.array(whole.n[often], pa.int64()), pa.array(sieved(hi, lo).astype(np.int64))]
        return pa.table(arrays, names=["lang", "ids", "n", "hash"])

    return merge


def _bitmap(spark: SparkSession, frequent: DataFrame, count: int):
    """The hashes of the frequent phrases as a broadcast bitmap of 16 bits for each, at most SIEVE_BITS."""
    bits = min(SIEVE_BITS, 1 << max(15, (16 * count).bit_length()))
    place = F.col("hash").bitwiseAND(bits - 1) + 1
    rows = frequent.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = bytearray(bits // 8)
    for row in rows.toLocalIterator():
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = bytes(row.bits)
    return spark.sparkContext.broadcast(bytes(out))


def counted(sequences: DataFrame, vocabulary: DataFrame, total: int, rules: Rules) -> list[DataFrame]:
    """For 2, 3, ... words the frequent phrases (lang, ids, n, hash), staged, as far as there are any."""
    spark = sequences.sparkSession
    bits = max(1, (vocabulary.agg(F.max("id")).first()[0] or 0).bit_length())
    if half_bits(rules.longest, bits) > 64:
        raise ValueError(f"word numbers of {bits} bits: {rules.longest} of them don't fit into two halves of 64 bits")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, sieve = [], None
    for order in range(2, rules.longest + 1):
        ranges = max(tasks, -(-total // RANGE_ENTRIES))
        prefix = min(half_bits(order, bits), (ranges - 1).bit_length(), 16)
        filters = sequences.mapInArrow(partial(_filters, order=order, bits=bits, prefix=prefix, sieve=sieve), "lang string, part int, filter binary")
        merged = filters.groupBy("lang", "part").applyInArrow(_merging(order, bits, rules.least), "lang string, ids array<int>, n long, hash long")
        level = staged_texts(merged, f"phrase-{order}")
        count = level.count()
        if not count:
            break
        found.append(level)
        sieve = _bitmap(spark, level, count)
    return found


def collocations(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first `rules.top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    n counts the words of the language, a the phrase; the phrase is cut where floor(1000 * a * n / (l * r)) is least,
    with l and r the counts of the parts, ties at the first cut. Order: score, then a, both descending, then phrase.

    A null text is an empty one, a null language is `und`. Repeated rows count each. Texts of any length are read
    whole and phrases don't reach beyond a piece. No rows, or none that repeat words often enough, give none. Other
    columns are not read. Up to 2**25 frequent words of a language can be numbered; more raise an error.
    """
    with scratch():
        texts = _texts(docs, text_col, lang_col)
        counts = words(texts)
        totals = stage(counts.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
        vocabulary = numbered(counts.where(F.col("n") >= rules.least))
        found = counted(coded(texts, vocabulary), vocabulary, totals.agg(F.sum("n")).first()[0] or 0, rules)
        schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        if not found:
            return docs.sparkSession.createDataFrame([], schema)
        phrases = stage(reduce(DataFrame.unionByName, [x.select("lang", "ids", F.col("n").alias("a")) for x in found]), "phrase-all")
        single = vocabulary.select("lang", F.array("id").alias("ids"), F.col("n").alias("a"))
        parts = checked_small(stage(phrases.unionByName(single), "phrase-parts"))
        sub = F.explode(F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1)))
        around = phrases.where(F.size("ids") > 2).select("lang", sub.alias("ids"), "a").groupBy("lang", "ids").agg(F.max("a").alias("longer"))
        rows = phrases.join(around, ["lang", "ids"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * rules.inside))
        cuts = rows.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
        cuts = cuts.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("rest"))
        for side, name in (("first", "l"), ("rest", "r")):
            cuts = cuts.join(parts.select("lang", F.col("ids").alias(side), F.col("a").alias(name)), ["lang", side])
        cuts = stage(cuts.join(F.broadcast(totals) if totals.count() < 10_000 else totals, "lang").select("lang", "ids", "a", "k", "l", "r", "n"), "phrase-cuts")
        wide = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
        score = F.call_function("div", wide["a"] * wide["n"] * F.lit(1000), wide["l"] * wide["r"])
        best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
        scored = stage(cuts.groupBy("lang", "ids", "a", "n").agg(best.alias("best")).select("lang", "ids", "a", "n", "best.score", "best.l", "best.r"), "phrase-scores")
        by_score = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        first = stage(scored.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= rules.top), "phrase-first")
        spelt = first.select("lang", "ids", F.posexplode("ids").alias("at", "id")).join(checked_small(vocabulary.select("lang", "id", "word")), ["lang", "id"])
        spelt = spelt.groupBy("lang", "ids").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word"))))["word"], " ").alias("phrase"))
        rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
        out = first.join(spelt, ["lang", "ids"]).withColumn("rank", rank).where(F.col("rank") <= rules.top)
        return stage(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases", keep=True)
