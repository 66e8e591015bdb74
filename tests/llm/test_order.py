"""Packing, sharding, mixing and running totals."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from stratalens.llm import mixing, packing, sharding
from stratalens.llm.common import running_totals


@pytest.mark.parametrize("within", [None, "g"])
def test_running_totals(spark, within):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, k int, v long").repartition(7)
    found = {r.k: r.total for r in running_totals(df, ["k"], "v", within).collect()}
    sums, expected = Counter(), {}
    for g, k, v in sorted(rows, key=lambda r: (r[0] if within else 0, r[1])):
        sums[g if within else 0] += v
        expected[k] = sums[g if within else 0]
    assert found == expected
    assert running_totals(df.where("false"), ["k"], "v", within).collect() == []


def padding(lengths, counts, boundaries):
    return sum(n * (min(b for b in boundaries if b >= x) - x) for x, n in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(12))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 60), rng.randrange(1, 10))
    counts, buckets = [rng.randrange(1, 50) for _ in lengths], rng.randrange(1, 5)
    found = packing.best_boundaries(lengths, counts, buckets)
    best = min(padding(lengths, counts, (*c, max(lengths))) for k in range(buckets) for c in combinations(lengths, k))
    assert len(found) <= buckets and padding(lengths, counts, found) == best
    assert packing.best_boundaries([], [], 3) == []


ODD_TEXTS = [(900, None), (901, ""), (902, " \t\n\x0b"), (903, "x"), (903, "x"), (None, "no id here"), (904, "long " * 30_000), (904, "  　")]


def sized(rows):
    for c in "\t\n\x0b\x0c\r":
        rows = [(d, (t or "").replace(c, " ")) for d, t in rows]
    return [(d, len([w for w in t.split(" ") if w])) for d, t in rows]


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 150)) for i in range(300)] + ODD_TEXTS
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(5)
    found = packing.pack(df, window=64, batch_tokens=512, buckets=4).collect()
    tokens = Counter()
    for r in found:
        assert r.start == 64 * r.piece and 0 <= r.length <= 64 and (r.length > 0) == (r.batch is not None)
        tokens[r.doc_id] += r.length
    wanted = Counter()
    for d, n in sized(rows):
        wanted[d] += n
    assert tokens == +wanted or tokens == wanted
    pieces = [(d, k) for d, n in sized(rows) for k in range(max(1, -(-n // 64)))]
    assert Counter((r.doc_id, r.piece) for r in found) == Counter(pieces)
    lengths = Counter(r.length for r in found if r.length)
    boundaries = packing.best_boundaries(list(lengths), list(lengths.values()), 4)
    batches = defaultdict(list)
    for r in found:
        if r.length:
            assert r.bucket == min(b for b in boundaries if b >= r.length)
            batches[r.bucket, r.batch].append(r.row)
    last = {bucket: max(n for b, n in batches if b == bucket) for bucket, _ in batches}
    for (bucket, n), held in batches.items():
        assert sorted(held) == list(range(len(held))) and len(held) * bucket <= 512
        assert len(held) == 512 // bucket or n == last[bucket]
    assert packing.pack(df.where("false")).collect() == []


def test_a_batch_holds_a_window(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), window=10, batch_tokens=9)


@pytest.mark.parametrize("bucket_bytes", [1, 10_000])
def test_shards(spark, bucket_bytes):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(203)] + ODD_TEXTS
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    found = [tuple(r) for r in sharding.sharded(df.repartition(3), shards=8, bucket_bytes=max(bucket_bytes, 200)).collect()]
    assert Counter((d, t) for d, t, _, _ in found) == Counter(rows)
    slots = defaultdict(list)
    for _, _, slot, shard in found:
        slots[shard].append(slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values()) and set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = [tuple(r) for r in sharding.sharded(df.repartition(6), shards=8, bucket_bytes=max(bucket_bytes, 200)).collect()]
    assert Counter(found) == Counter(again)
    order = [d for d, *_ in sorted(found, key=lambda r: (r[3], r[2])) if d is not None and d < 203]
    assert sum(abs(a - b) for a, b in zip(order, order[1:])) > 203 * 30  # neighbours do not stay together


def test_fewer_rows_than_shards_and_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.slot) for r in sharding.sharded(df).collect()) == [(1, 0), (2, 0)]
    assert sharding.sharded(df.where("false")).collect() == []


def plain_targets(sizes, weights, budget, most):
    """Shared again and again until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = budget * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in open_}
        for s in over:
            fixed[s] = float(most * sizes[s])
        left = budget * sum(sizes.values()) - sum(fixed.values())
        if len(fixed) == len(names):
            return fixed


def plain_mix(units, targets, budget, most, seed):
    queue, places = defaultdict(int), []
    names = sorted(targets, key=lambda s: (s is None, s or ""))
    total = defaultdict(int)
    for (_, s, size), n in units.items():
        total[s] += size * n
    key = {u: hashlib.md5(f"{seed}:{'' if u[0] is None else u[0]}".encode()).hexdigest() for u in units}
    for u in sorted(units, key=lambda u: (names.index(u[1]), key[u], u[2])):
        queue[u[1]] += u[2] * units[u]
        for k in range(most):
            finish = (queue[u[1]] + k * total[u[1]]) / targets[u[1]] if targets[u[1]] > 0 else 0.0
            places.append(((finish, names.index(u[1]), k, key[u], u[2]), u))
    copies, served, limit = Counter(), 0, int(budget * sum(total.values()))
    for _, u in sorted(places):
        served += u[2] * units[u]
        if served > limit:
            break
        copies[u] += 1
    return copies


def mix_rows():
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "B", "é", None, "c", "d"]), "w " * rng.randrange(0, 40)) for i in range(400)]
    return rows + [(i, "odd", t) for i, t in ODD_TEXTS] + [rows[5], (777, "empty", ""), (778, "empty", None)]


def test_mix_equals_the_plain_queue(spark):
    rows = mix_rows()
    schema = "doc_id long, source string, text string, size string, copies int, _size int"
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], schema).repartition(5)
    units = Counter((d, s, n) for (d, s, _), (_, n) in zip(rows, sized([(d, t) for d, _, t in rows])))
    sizes = defaultdict(int)
    for (_, s, n), times in units.items():
        sizes[s] += n * times
    targets = plain_targets(dict(sizes), mixing.WEIGHTS, 1.5, 2)
    copies = plain_mix(units, targets, 1.5, 2, mixing.SEED)
    found = mixing.fair_queue(df).collect()
    assert {(r.doc_id, r.source, r["size"]): r.rows for r in found} == dict(units)
    assert {(r.doc_id, r.source, r["size"]): r.copies for r in found if r["size"]} == {u: copies[u] for u in units if u[2]}
    assert all(abs(r.target - targets[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in found)
    for s, target in targets.items():
        taken = sum(u[2] * units[u] * copies[u] for u in units if u[1] == s)
        assert abs(taken - target) <= max([u[2] * units[u] for u in units if u[1] == s] + [40])
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    kept = mixed.collect()
    got = Counter((r.doc_id, r.source, n) for r, (_, n) in zip(kept, sized([(r.doc_id, r.text) for r in kept])))
    assert got == +Counter({u: units[u] * copies[u] for u in units if u[2]})


def test_empty_mixes(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert {(r["size"], r.target) for r in mixing.fair_queue(df).collect()} == {(0, 0.0)} and mixing.mixed(df).collect() == []
    assert mixing.fair_queue(df.where("false")).collect() == []
