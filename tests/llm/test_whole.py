"""Training-data operators on what a bound would leave out."""

from pathlib import Path

import numpy as np

from weftline.llm import packing, pii, shared, suffix_dedup

SAME = np.where(np.eye(pii.LABELS) > 0, 3.0, -3.0)


def test_labels_reach_every_repeat(spark):
    text = "word 4155550123 " * 5 + "call +14155550123 " + "word 4155550123 " * 30
    field = pii.Field(np.zeros((pii.BITS + 1, pii.LABELS)), np.stack([SAME, SAME]))
    d = spark.createDataFrame([(1, text), (2, "word 4155550123 " * 9), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(d, field, redact=True).collect()}
    assert len(found[1].base) == 1 and len(found[1].added) == 35 and {s.kind for s in found[1].added} == {"phone"}
    assert "0123" not in found[1].redacted_text and not found[2].added and not found[3].added


def test_messages_settle():
    n = 40
    unary = np.zeros((2 * n + 2, pii.LABELS))
    unary[0] = unary[n] = -20.0
    unary[0, 4] = unary[n, 1] = 0.0
    edges = np.array([(i, i + 1, 0) for i in range(n - 1)] + [(i, i + 1, 0) for i in range(n, 2 * n + 1)])
    got = pii.propagate(unary, edges, np.stack([SAME, SAME]), np.repeat([3, 7], [n, n + 2]))
    step = np.exp(SAME) / np.exp(SAME).sum(1)
    for at, label, size in ((0, 4, n), (n, 1, n + 2)):
        want = np.exp(unary[at]) / np.exp(unary[at]).sum()
        for k in range(size):
            assert np.abs(got[at + k] - want).max() < 1e-3
            want = want @ step


def test_packing_cuts_only_what_fits_nowhere():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        lengths, capacity = rng.integers(1, 150, 300), 64
        pieces = list(packing.pack(lengths, capacity, 1.0, 1 / 64))
        room, cost, done = {}, {}, dict.fromkeys(range(len(lengths)), 0)
        for _, _, n, k, _ in pieces:
            room[k], cost[k] = room.get(k, 0) + n, 0.0
        last = capacity
        for i, at, n, k, _ in pieces:
            left = int(lengths[i]) - done[i]
            assert at == done[i]
            if left < capacity:
                fits = [x for x in room if room[x] >= left] or [x for x in room if room[x]]
                assert left <= last and k == min(fits, key=lambda x: (cost[x], x)) and n == min(left, room[k])
                last = left
            room[k] -= n
            cost[k] += n + n * n / 64
            done[i] += n
        assert [done[i] for i in range(len(lengths))] == lengths.tolist() and not any(room.values())


def test_suffixes_by_ranges(spark, monkeypatch):
    """Ranges that are shuffled one after the other give what one gives; blocks are not shuffled to be cut, and nothing but what the result reads is left on the disk."""
    d = spark.createDataFrame([(i, f"{i} " + " ".join(f"w{(i % 7) * 100 + k}" for k in range(60)) + f" end {i}") for i in range(60)] + [(None, "x" * 99), (61, None)], "doc_id long, text string")
    answer = lambda df: sorted(map(str, df.collect()))
    once = answer(suffix_dedup.suffix_dedup(d))
    before = {p.name for p in Path(shared.shared_dir(spark).removeprefix("file://")).iterdir()}
    monkeypatch.setattr(suffix_dedup, "PASS_BYTES", 4000, raising=False)
    monkeypatch.setattr(suffix_dedup, "DEALT_ROWS", 100, raising=False)
    got = suffix_dedup.suffix_dedup(d)
    left = {p.name.split("-")[0] for p in Path(shared.shared_dir(spark).removeprefix("file://")).iterdir() if p.name not in before}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert answer(got) == once and left == {"blocks", "buckets", "settled"}
    assert plan.count("Exchange hashpartitioning(block") == 1  # what is removed goes to the blocks
