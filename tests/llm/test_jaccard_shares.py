"""Shingles in common are counted by class before a bucket is sent on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from siltstone.llm.jaccard_join import _by_slice, _near

NAMES = np.frombuffer(b"".join(bytes([i]) * 16 for i in (1, 2, 3)), dtype="V16")


def part(names, needs, tokens, keys, members):
    return _by_slice(1, NAMES[names], np.array(needs), np.array(tokens), np.array(keys, dtype=np.int64), NAMES[members])


def test_only_classes_that_share_enough_in_all_ranges_keep_buckets():
    two = [part([0, 1], [3, 2], [1, 1], [70, 70], [0, 1]), part([0, 2], [3, 4], [2, 3], [-9, -9], [0, 2])]
    got = _near(pa.Table.from_batches(two)).to_pylist()
    assert [(r["key"], r["node"][0]) for r in got] == [(70, 1), (-9, 1)]


def test_slices_hold_every_class_and_member_once():
    batch = _by_slice(2, NAMES, np.array([1, 2, 3]), np.array([4, 5, 6]), np.array([8, 9], dtype=np.int64), NAMES[[2, 0]])
    got = [(n, int(s)) for s, names in zip(batch["slice"].to_pylist(), batch["nodes"].to_pylist(), strict=True) for n in names[::16]]
    assert sorted(got) == [(1, 1), (2, 0), (3, 1)] and sum(len(x.as_py()) for x in batch["keys"]) == 16
