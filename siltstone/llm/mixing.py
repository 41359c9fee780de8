"""Mixing sources to target weights along a curriculum whose weights vary with training time.

Each source has a weight schedule: knots (time, weight) over training time 0 to 1, linear between
them. Its integral is the source's weight in the whole mix. The targets share the token budget by
these weights; a target stops at `max_repeat` times its source's size and the excess goes to the
others by weight. Within a source the documents stand in a seeded order, pass after pass; the
tokens before a document, inverted through the integral of the schedule, give the training position
at which its tokens are due. The result is range-sorted by position.

All work is DataFrame functions. The running sum is taken in two levels (sums per slice of a
source, then within a slice), so a source with a third of all rows is spread over all tasks.

Whole documents are shuffled once. Narrow rows first say which slices, or parts of slices, are due in
which range of training time; each document then goes straight to the partitions of its copies, where
the running sum within its slice gives its exact position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, checked_small, scratch, stage, tasks_for

Schedule = Sequence[tuple[float, float]]

#: Integrals 3, 1 and 2: the first kind of source fades out, the second fades in, the third is level.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 2.0), (1.0, 2.0)))

#: Rows of a source that one slice should hold; bytes that a word of a document takes, white space included, about.
SLICE_ROWS, WORD_BYTES = 20_000, 8


def _segments(schedule: Schedule) -> Column:
    """The schedule as an array of (from, to, weight, slope, integral before)."""
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        out.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in (("t0", t0), ("t1", t1), ("w", w0), ("slope", (w1 - w0) / (t1 - t0)), ("before", before)))))
        before += (w0 + w1) / 2 * (t1 - t0)
    return F.array(*out)


def integral(schedule: Schedule) -> float:
    return sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def _inverted(segments: Column, y: Column) -> Column:
    """The time at which the integral of the schedule reaches y."""
    s = F.element_at(F.filter(segments, lambda x: (x["before"] <= y) | (x["t0"] == F.element_at(segments, 1)["t0"])), -1)
    left = F.greatest(y - s["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(s["w"] * s["w"] + 2.0 * s["slope"] * left, F.lit(0.0)))
    return F.least(s["t1"], s["t0"] + F.when(left > 0, 2.0 * left / (s["w"] + root)).otherwise(0.0))


def _integrated(schedule: Schedule, t: Column) -> Column:
    """The integral of the schedule up to time t."""
    segments = _segments(schedule)
    s = F.element_at(F.filter(segments, lambda x: (x["t0"] <= t) | (x["t0"] == F.element_at(segments, 1)["t0"])), -1)
    gone = F.greatest(F.least(t, s["t1"]) - s["t0"], F.lit(0.0))
    return s["before"] + gone * (s["w"] + s["slope"] * gone / 2.0)


def targets(sizes: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """sizes (key, source, source_size; a row per source) with weight, target and the schedule's turn (from 1).

    Sources in code point order, null last, take the schedules of the curriculum in turn. The level
    at which sharing by weight ends is found in closed form: in order of capacity over weight, the
    first source that its share doesn't fill settles the level for itself and all after it. A source whose schedule
    is 0 throughout has a target of 0, also where others can't take all of the budget.
    """
    order = W.orderBy(F.col("source").isNull(), "source")  # a row per source
    turn = (F.row_number().over(order) - 1) % len(curriculum)
    weight = F.element_at(F.array(*(F.lit(float(integral(s))) for s in curriculum)), (turn + 1).cast("int"))
    everything = W.partitionBy()
    filling = W.orderBy("ratio", F.col("source").isNull(), "source")
    turn_at = F.col("turn")
    t = sizes.select("key", "source", "source_size", weight.alias("weight"), (turn + 1).cast("int").alias("turn"))
    t = t.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("level", F.try_divide(left, F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing))))
    t = t.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source"))).over(everything))
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return t.select("key", "source_size", "weight", turn_at.alias("turn"), target.alias("target"))


def _columns(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """key, source, ticket, id and size of the rows of docs. The ticket orders a source and picks the slice; it
    hashes identifier and text, so rows that share an identifier, or have none, are told apart and spread."""
    text, source = docs[text_col], docs[source_col]
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return [key.alias("key"), source.alias("source"), ticket.alias("ticket"), docs[id_col].alias("id"), size.alias("size")]


def _sliced(narrow: DataFrame, curriculum: Sequence[Schedule], share: float, max_repeat: int) -> tuple[DataFrame, Column]:
    """The staged slices (key, slice, before, words, source_size, weight, turn, target), and the slice of a row."""
    n, hexes = narrow.count(), 2
    while n > SLICE_ROWS * 16**hexes and hexes < 6:
        hexes += 1
    sliced = F.substring("ticket", 1, hexes).alias("slice")
    slices = stage(narrow.groupBy("key", sliced).agg(F.first("source").alias("source"), F.sum("size").alias("words")), "mix-slices")
    sources = stage(targets(slices.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), curriculum, share, max_repeat), "mix-targets")
    before = F.coalesce(F.sum("words").over(W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slices = stage(slices.select("key", "slice", before.alias("before"), "words"), "mix-before")
    return stage(slices.join(checked_small(sources), "key"), "mix-placed"), sliced


def _goal() -> Column:
    return F.floor(F.col("target") + 0.5)


def _due(curriculum: Sequence[Schedule], at: Column) -> Column:
    """The training time at which the word of that number in a source's demand is due."""
    segments = F.element_at(F.array(*(_segments(s) for s in curriculum)), F.col("turn"))
    return _inverted(segments, at / _goal() * F.col("weight"))


def mix(docs: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, share: float = 1.5, max_repeat: int = 2, seed: int = 17, keep: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per document: `row` (a struct of its columns in `keep`, else of its identifier), key, ticket, size, source_size, weight,
    target, taken, copies (array of the words taken in each pass) and positions (array of training times 0 to
    1, for passes of which words are taken).

    A null text has size 0; a null source is a source of its own, last in order. Repeated rows count
    each; rows alike in identifier, text and source are interchangeable. Documents of size 0 are never taken.
    The last document of a pass that the target reaches is taken in part, so that a source's words sum to its
    target rounded; texts of any length count whole. An empty table gives an empty result. Columns of any name
    are safe inside `row`. Sources are ranked in one task, a row each.
    """
    columns = _columns(docs, seed, id_col, text_col, source_col)
    with scratch():
        rows = stage(docs.select(F.struct(*(keep or [id_col])).alias("row"), *columns), "mix-sizes")
        slices, sliced = _sliced(rows, curriculum, share, max_repeat)
        inside = W.partitionBy("key", "slice").orderBy("ticket", "id", "size").rowsBetween(W.unboundedPreceding, 0)
        placed = rows.withColumn("slice", sliced).join(checked_small(slices.drop("words")), ["key", "slice"]).withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
        starts = F.transform(F.sequence(F.lit(0), F.lit(max_repeat - 1)), lambda c: F.col("start") + c * F.col("source_size"))
        placed = placed.withColumn("starts", starts).withColumn("copies", F.transform("starts", lambda at: F.greatest(F.lit(0), F.least(_goal() - at, F.col("size"))).cast("long")))
        due = F.transform(F.filter(F.arrays_zip("starts", "copies"), lambda x: x["copies"] > 0), lambda x: _due(curriculum, x["starts"] + x["copies"] / 2.0))
        taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x)
        return stage(placed.select("row", "key", "ticket", "size", "source_size", "weight", "target", taken.alias("taken"), "copies", due.alias("positions")), "mix-positions", keep=True)


def in_training_order(mixed: DataFrame, position: Column) -> DataFrame:
    """mixed, a staged table, range-sorted by position; what the mix leaves out (null) follows in the seeded order."""
    after = 1.0 + F.conv(F.substring("ticket", 1, 8), 16, 10).cast("double") / float(1 << 32)
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.withColumn("due", F.coalesce(position, after)).repartitionByRange(n, "due").sortWithinPartitions("due", "ticket")


def _weight_at(schedule: Schedule, t: float) -> float:
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        if t0 <= t <= t1:
            return w0 + (w1 - w0) * (t - t0) / (t1 - t0)
    return 0.0


def _demand(slices: DataFrame, curriculum: Sequence[Schedule]) -> Schedule:
    """How much of all words is due around each time, as one schedule whose integral is 1. A source demands its goal in
    proportion to its schedule, so the sources of one schedule add up to one number, of which there are as many as
    schedules."""
    each = slices.select("key", "turn", "weight", _goal().alias("goal")).distinct().where("goal > 0")
    by_turn = {r.turn: r.per_weight for r in each.groupBy("turn").agg(F.sum(F.col("goal") / F.col("weight")).alias("per_weight")).collect()}
    total = sum(integral(curriculum[turn - 1]) * per for turn, per in by_turn.items()) or 1.0
    knots = sorted({t for schedule in curriculum for t, _ in schedule})
    return [(t, sum(_weight_at(curriculum[turn - 1], t) * per / total for turn, per in sorted(by_turn.items()))) for t in knots]


def _cuts(narrow: DataFrame, slices: DataFrame, sliced: Column, curriculum: Sequence[Schedule], max_repeat: int, parts: int) -> DataFrame:
    """For each slice (key, slice) of which documents are taken: weight, turn, target and, as an array, its runs of
    tickets that are due within one part of training time: pass, lo and hi (tickets from lo to below hi; null is
    the end), part, and base, the words before the run in the source's demand. Parts are stretches of time in which
    equally many words are due, however steep the schedules are."""
    demand = _demand(slices, curriculum)
    part = lambda due: F.least(F.lit(parts - 1), F.floor(_integrated(demand, F.col(due)) * parts)).cast("int")
    each = slices.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))).withColumn("from", F.col("before") + F.col("pass") * F.col("source_size")).where((F.col("words") > 0) & (F.col("from") < _goal()))
    each = each.withColumn("first_due", _due(curriculum, F.col("from"))).withColumn("last_due", _due(curriculum, F.least(_goal(), F.col("from") + F.col("words"))))
    each = stage(each.withColumn("part", part("first_due")).withColumn("last", part("last_due")), "mix-passes")
    about = ["key", "slice", "pass", "weight", "turn", "target"]
    whole = each.where("part = last").select(*about, F.lit("").alias("lo"), "part", F.col("from").alias("base"))
    # A slice that ends in another part is cut between tickets; rows with one ticket are alike and stay together.
    tickets = narrow.where("size > 0").withColumn("slice", sliced).join(each.where("part != last").select(*about, "from"), ["key", "slice"])
    tickets = tickets.groupBy(*about, "from", "ticket").agg(F.sum("size").alias("words"), F.first("size").alias("size"))
    inside = W.partitionBy("key", "slice", "pass").orderBy("ticket").rowsBetween(W.unboundedPreceding, 0)
    tickets = tickets.withColumn("start", F.col("from") + F.sum("words").over(inside) - F.col("words"))
    middle = F.col("start") + F.greatest(F.lit(0), F.least(_goal() - F.col("start"), F.col("size"))) / 2.0
    tickets = tickets.where(F.col("start") < _goal()).withColumn("due", _due(curriculum, middle))
    cut = tickets.withColumn("part", part("due")).groupBy(*about, "part").agg(F.min("ticket").alias("lo"), F.min("start").alias("base"))
    runs = whole.unionByName(cut.select(*whole.columns))
    hi = F.lead("lo").over(W.partitionBy("key", "slice", "pass").orderBy("part"))
    runs = runs.withColumn("hi", hi).groupBy("key", "slice", "weight", "turn", "target").agg(F.collect_list(F.struct("pass", "lo", "hi", "part", "base")).alias("runs"))
    return stage(runs, "mix-runs", keep=True)


def mixed_documents(docs: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, share: float = 1.5, max_repeat: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents themselves, whole, each as often as the mix takes at least half of it in a pass, in training
    order over partitions and within them, with the columns of docs, whose names may be any. Null texts and those
    without words are never taken; else as mix()."""
    columns = _columns(docs, seed, id_col, text_col, source_col)
    with scratch():
        narrow = stage(docs.select(*columns), "mix-sizes")
        slices, sliced = _sliced(narrow, curriculum, share, max_repeat)
        parts = tasks_for(docs.sparkSession, (slices.agg(F.sum("words")).first()[0] or 0) * share * WORD_BYTES)
        runs = _cuts(narrow, slices, sliced, curriculum, max_repeat, parts)

    rows = docs.select(F.struct(*docs.columns).alias("row"), *columns).where("size > 0").drop("source", "id").withColumn("slice", sliced)
    here = F.filter("runs", lambda r: (r["lo"] <= F.col("ticket")) & (r["hi"].isNull() | (F.col("ticket") < r["hi"])))
    sent = rows.join(checked_small(runs), ["key", "slice"]).withColumn("run", F.explode(here))
    sent = sent.select("row", "key", "ticket", "size", "slice", "weight", "turn", "target", "run.part", "run.pass", "run.base")
    inside = W.partitionBy("part", "key", "slice", "pass").orderBy("ticket").rowsBetween(W.unboundedPreceding, 0)
    placed = sent.repartitionById(parts, "part").withColumn("start", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    copy = F.greatest(F.lit(0), F.least(_goal() - F.col("start"), F.col("size")))
    chosen = placed.withColumn("copy", copy).where("copy > 0 and 2 * copy >= size")
    return chosen.withColumn("due", _due(curriculum, F.col("start") + F.col("copy") / 2.0)).sortWithinPartitions("due", "ticket").select("row.*")
