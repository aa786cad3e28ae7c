import math
import random

import pytest

from kifuframe.operators import ordering
from kifuframe.operators import replay_table as rt

SCHEMA = "seq bigint, priority double"


@pytest.fixture()
def held(spark):
    return spark.createDataFrame([(i, 0.1 + (i % 7)) for i in range(200)], SCHEMA)


def test_push_into_empty_and_filled(spark):
    empty = spark.createDataFrame([], SCHEMA)
    batch = spark.createDataFrame([(5,), (6,)], "seq bigint")
    assert sorted(map(tuple, rt.push(empty, batch, ["seq"]).collect())) == [(0, 1.0), (1, 1.0)]
    filled = spark.createDataFrame([(0, 0.2), (1, 3.5)], SCHEMA)
    assert sorted(map(tuple, rt.push(filled, batch, ["seq"]).collect())) == [(0, 0.2), (1, 3.5), (2, 3.5), (3, 3.5)]
    assert rt.push(filled, batch.limit(0), ["seq"]).count() == 2


def test_evict_keeps_newest(held):
    assert sorted(r.seq for r in rt.evict(held, 50).collect()) == list(range(150, 200))
    assert rt.evict(held, 1000).count() == 200


def test_ring_keeps_its_size_whatever_the_gaps(spark, held):
    batch = spark.createDataFrame([(i * i * 1000,) for i in range(10)], "seq bigint")
    pushed = rt.push(held, batch, ["seq"])
    assert sorted(r.seq for r in rt.evict(pushed, 50).collect()) == list(range(160, 210))
    gaps = spark.createDataFrame([(i ** 5, 1.0) for i in range(300)], SCHEMA)
    assert sorted(r.seq for r in rt.evict(gaps, 77).collect()) == [i ** 5 for i in range(223, 300)]
    repeated = spark.createDataFrame([(i // 40, 1.0) for i in range(200)] + [(None, 1.0)], SCHEMA)
    kept = [r.seq for r in rt.evict(repeated, 50).collect()]
    assert len(kept) == 50 and kept.count(4) == 40 and kept.count(3) == 10
    assert rt.evict(held, 0).count() == 0


def test_probabilities_and_weights(held):
    rows = rt.sampling_probs(held, 0.6).collect()
    scaled = {r.seq: r.priority ** 0.6 for r in rows}
    assert {r.seq: r.prob for r in rows} == pytest.approx({s: w / sum(scaled.values()) for s, w in scaled.items()})
    probs = rt.sampling_probs(held)
    drawn = rt.importance_weights(rt.sample(probs, 20, 3), probs).collect()
    raw = {r.seq: (200 * r.prob) ** -0.4 for r in drawn}
    assert {r.seq: r.weight for r in drawn} == pytest.approx({s: w / max(raw.values()) for s, w in raw.items()})


def test_sample_is_repeatable_without_replacement(held):
    first, again = rt.sample(held, 40, 1).collect(), rt.sample(held.repartition(7), 40, 1).collect()
    assert sorted(first) == sorted(again) and len({r.seq for r in first}) == 40
    assert {r.seq for r in first} != {r.seq for r in rt.sample(held, 40, 2).collect()}
    assert rt.sample(held, 500, 1).count() == 200


def test_sample_prefers_high_priority(spark):
    held = spark.createDataFrame([(i, 8.0 if i < 500 else 1.0) for i in range(1000)], SCHEMA)
    heavy = sum(rt.sample(held, 100, seed, alpha=1.0).where("seq < 500").count() for seed in range(5))
    assert heavy / 500 == pytest.approx(8 / 9, abs=0.05)


def test_update_and_uniform(spark, held):
    td = spark.createDataFrame([(3, -2.0), (4, 0.0)], "seq bigint, td_error double")
    rows = {r.seq: r.priority for r in rt.update_priorities(held, td).collect()}
    assert rows[3] == pytest.approx(2.000001) and rows[4] == pytest.approx(1e-6) and rows[5] == 5.1
    assert len(rows) == 200
    twice = spark.createDataFrame([(3, -2.0, 1), (3, 0.5, 2)], "seq bigint, td_error double, at int")
    assert rt.update_priorities(held, twice).where("seq = 3").first().priority == pytest.approx(2.000001)
    assert rt.update_priorities(held, twice, "at").where("seq = 3").first().priority == pytest.approx(0.500001)
    assert rt.update_priorities(held, twice).count() == 200
    uniform = rt.sample_uniform(held, 10, 1).collect()
    assert len(uniform) == 10 and all(r.weight == 1.0 for r in uniform) and math.isclose(sum(r.weight for r in uniform), 10)


@pytest.mark.parametrize("few", [1, 7, 60])
def test_first_rows_by_counting(spark, few):
    rng = random.Random(few)
    rows = [(rng.choice([rng.random() ** 9 * 1e12, 0.25, -3.0]), rng.randrange(40) - 20) for _ in range(400)] + [(0.25, 1 << 62), (0.25, -(1 << 62))]
    table = spark.createDataFrame(rows, "a double, b bigint").repartition(3)
    for k in (0, 1, 70, 150, 333, 401, 402, 900):
        got = sorted(map(tuple, ordering.first_rows(table, k, ["a", "b"], few).collect()))
        assert got == sorted(rows)[:k], k


def test_samples_by_counting_are_the_same(spark, held, monkeypatch):
    odd = held.unionByName(spark.createDataFrame([(900, 0.0), (901, None), (None, 2.0)], SCHEMA))
    draw = lambda: [sorted(map(str, f(odd, 90, 4).collect())) for f in (rt.sample, rt.sample_uniform)]
    want = draw()
    monkeypatch.setattr(rt, "first_rows", lambda df, k, order: ordering.first_rows(df, k, order, 5))
    assert draw() == want and all(len(x) == 90 for x in want)
    assert any("seq=901" in row for row in want[0]) and not any("seq=900" in row for row in want[0])
