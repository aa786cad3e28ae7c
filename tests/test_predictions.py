import numpy as np
import pytest
from pyspark.sql import functions as F

from kifuframe.functions import policy
from kifuframe.operators import losses, predictions
from kifuframe.plans import fixtures

SIZE = 9
SCHEMA = ("position_id bigint, logits array<double>, fast_logits array<double>, value double, legal array<int>, "
          "target_value double")


def soft(x, t=1.0):
    e = np.exp((np.asarray(x) - np.max(x)) / t)
    return e / e.sum()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    made = []
    for i in range(60):
        legal = sorted(rng.choice(SIZE, rng.integers(1, SIZE + 1), replace=False).tolist())
        made.append((i, rng.normal(0, 3, SIZE).tolist(), rng.normal(0, 3, SIZE).tolist(), float(rng.uniform(-1, 1)),
                     legal, float(rng.choice([-1, 0, 1]))))
    made.append((60, [0.0] * SIZE, [1000.0] + [0.0] * (SIZE - 1), 0.0, [2, 5], 1.0))
    made.append((61, [1.0] * SIZE, [1.0] * SIZE, 0.0, [], 0.0))
    return made


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def by_id(frame):
    return {r.position_id: r for r in frame.collect()}


def test_softmax_and_mask(df, rows):
    plain, masked = by_id(predictions.softmax(df, 0.5)), by_id(predictions.masked_policy(df, 2.0))
    for i, x, _, _, legal, _ in rows:
        assert plain[i].probs == pytest.approx(soft(x, 0.5))
        if legal:
            p = soft(x, 2.0)
            want = np.where(np.isin(np.arange(SIZE), legal), p, 0) / p[legal].sum()
            assert masked[i].probs == pytest.approx(want)
            assert sum(masked[i].probs) == pytest.approx(1)
    assert by_id(predictions.policy_distribution(df))[3].probs == pytest.approx(soft(rows[3][1]))


def test_choices_are_legal(df, rows):
    greedy, drawn = by_id(predictions.greedy_move(df)), by_id(predictions.sample_move(df, 1))
    for i, x, _, _, legal, _ in rows:
        if not legal:
            assert greedy[i].move is None and drawn[i].move is None
            continue
        assert greedy[i].move == legal[int(np.argmax(np.asarray(x)[legal]))]
        assert drawn[i].move in legal
    assert greedy[60].move == 2


def test_draws_follow_the_policy(spark):
    x, legal = [0.0, 1.0, 2.0, 0.5], [0, 2, 3]
    df = spark.range(20_000).select(
        F.col("id").alias("position_id"), F.lit(x).alias("logits"), F.lit(legal).alias("legal"))
    counts = {r.move: r["count"] for r in predictions.sample_move(df, 9).groupBy("move").count().collect()}
    p = soft(x)[legal] / soft(x)[legal].sum()
    assert set(counts) == set(legal)
    for cell, share in zip(legal, p):
        assert counts[cell] / 20_000 == pytest.approx(share, abs=0.015)


def test_rankings(df, rows):
    candidates = predictions.candidate_moves(df, 3).collect()
    suggested = predictions.suggest_moves(df, 3, 4).collect()
    heads = predictions.compare_heads(df, 3, 2).collect()
    for i, x, f, _, legal, _ in rows:
        p = soft(x)
        want = sorted(legal, key=lambda c: (-p[c], c))[:3]
        assert [r.cell for r in sorted((r for r in candidates if r.position_id == i), key=lambda r: r.rank)] == want
        best = sorted((r for r in suggested if r.position_id == i), key=lambda r: r.rank)
        order = sorted(range(SIZE), key=lambda c: (-p[c], c))[:4]
        assert [(r.cell, r.row, r.col) for r in best] == [(c, c // 3, c % 3) for c in order]
        assert [r.prob for r in best] == pytest.approx([p[c] for c in order])
        fast = [r.cell for r in sorted(
            (r for r in heads if r.position_id == i and r.head == "fast_policy"), key=lambda r: r.rank)]
        assert fast == sorted(range(SIZE), key=lambda c: (-soft(f)[c], c))[:2]


def test_evaluate(df, rows):
    got = by_id(predictions.evaluate_positions(df))
    for i, x, _, value, _, _ in rows:
        assert (got[i].best_move, got[i].value) == (int(np.argmax(x)), value)
        assert got[i].best_prob == pytest.approx(soft(x).max())


def test_blend(spark, df, rows):
    rng = np.random.default_rng(8)
    nexts = {(i, c): float(rng.uniform(-1, 1)) for i, *_ in rows for c in range(SIZE)}
    table = spark.createDataFrame([(i, c, v) for (i, c), v in nexts.items()], "position_id bigint, cell int, next_value double")
    got = by_id(predictions.blend_select(df, table, 3))
    for i, x, _, _, legal, _ in rows:
        p = soft(x)
        move, best = (legal[0] if legal else 0), None
        for c in sorted(range(SIZE), key=lambda c: (-p[c], c))[:3]:
            if c in legal:
                score = 0.7 * p[c] + 0.3 * nexts[i, c]
                if best is None or score > best:
                    move, best = c, score
        assert got[i].move == move
        assert (got[i].score is None) == (best is None)


def test_losses(df, rows):
    target = policy.one_hot(F.lit(4), SIZE)
    ce = by_id(losses.policy_cross_entropy(df, target))
    kl, fast = by_id(losses.fast_kl(df)), by_id(losses.fast_cross_entropy(df))
    mse = by_id(losses.value_mse(df))
    for i, x, f, value, _, want in rows[:60]:
        lp, lq = np.log(soft(x)), np.log(soft(f))
        assert ce[i].policy_loss == pytest.approx(-lp[4])
        assert kl[i].fast_loss == pytest.approx((soft(x) * (lp - lq)).sum())
        assert fast[i].fast_loss == pytest.approx(-(soft(x) * lq).sum())
        assert mse[i].value_loss == pytest.approx((value - want) ** 2)


def test_total_and_epoch_loss(spark):
    data = [(0, 0, 1.0, 2.0, 4.0, 0.5), (0, 0, 3.0, 0.0, 2.0, 1.0), (0, 1, 5.0, 1.0, 0.0, 1.0), (1, 0, 1.0, 1.0, 2.0, 1.0)]
    df = spark.createDataFrame(
        data, "epoch int, batch int, policy_loss double, value_loss double, fast_loss double, w double")
    weighted = {(r.epoch, r.batch): r for r in losses.total_loss(df, ["epoch", "batch"], "w").collect()}
    assert weighted[0, 0].policy_loss == 1.75 and weighted[0, 0].total_loss == pytest.approx(1.75 + 0.5 + 0.5 * 2.0)
    plain = losses.total_loss(df, ["epoch", "batch"])
    means = {r.epoch: (r.loss, r.batches) for r in losses.epoch_loss(plain).collect()}
    assert means[0] == (pytest.approx((4.5 + 6.0) / 2), 2)
    assert means[None] == (pytest.approx((4.5 + 6.0 + 3.0) / 3), 3)


def test_schedules(spark):
    rows = spark.createDataFrame([(0,), (2500,), (5000,), (100_000,)], "s int").select(
        losses.cosine_lr(F.col("s")).alias("lr"), losses.temperature(F.col("s")).alias("t")).collect()
    assert [r.lr for r in rows[:3]] == pytest.approx([1e-3, (1e-3 + 1e-5) / 2, 1e-5])
    assert rows[0].t == 1.0 and rows[3].t == 0.1 and rows[1].t == pytest.approx(0.9999 ** 2500)


def test_expand(spark):
    held = spark.createDataFrame(
        [(1, 0, 1, [3], [5, 7])], "game_id int, ply int, player int, own_cells array<int>, opp_cells array<int>")
    tried = spark.createDataFrame([(1, 0, 0), (1, 0, 8)], "game_id int, ply int, cell int")
    rows = predictions.expand_positions(held, tried).orderBy("child_cell").collect()
    assert [(r.player, r.own_cells, r.opp_cells) for r in rows] == [(-1, [5, 7], [0, 3]), (-1, [5, 7], [3, 8])]
    arrays = held.withColumn("logits", F.lit([float(c) for c in range(9)])).withColumn("legal", F.lit([0, 4, 8]))
    children = predictions.expand_positions(arrays, predictions.candidate_array(2))
    assert sorted(r.child_cell for r in children.collect()) == [4, 8]
    assert "Exchange" not in children._jdf.queryExecution().executedPlan().toString()


def test_backup_equals_recursion(spark):
    rng = np.random.default_rng(4)
    parent = {0: None, **{i: int(rng.integers(0, i)) for i in range(1, 40)}}
    level = {0: 0}
    for i in range(1, 40):
        level[i] = level[parent[i]] + 1
    reward = {i: float(rng.uniform(-1, 1)) for i in parent}
    leaf = {i: float(rng.uniform(-1, 1)) for i in parent}

    def value(i):
        kids = [k for k in parent if parent[k] == i]
        if not kids:
            return leaf[i]
        if level[i] % 2 == 0:
            return max(value(k) + reward[k] for k in kids)
        return min(value(k) - reward[k] for k in kids)

    nodes = spark.createDataFrame(
        [(i, parent[i], level[i], reward[i], leaf[i]) for i in parent],
        "node bigint, parent bigint, level int, reward double, leaf_value double")
    got = {r.node: r.value for r in predictions.backup_tree(nodes).collect()}
    assert got == pytest.approx({i: value(i) for i in parent})
    moved = nodes.withColumn("level", F.when(F.col("node") == max(parent), F.col("level") + 1).otherwise(F.col("level")))
    with pytest.raises(Exception, match="no node one level up"):
        predictions.backup_tree(moved).collect()


def backed_up(rows):
    """Values by one pass from the deepest level up; a null value or reward of a child is passed over."""
    kids, out = {}, {}
    for node, parent, *_ in rows:
        kids.setdefault(parent, []).append(node)
    reward = {r[0]: r[3] for r in rows}
    for node, _, level, _, leaf in sorted(rows, key=lambda r: -r[2]):
        sign, best = (1, max) if level % 2 == 0 else (-1, min)
        given = [out[k] + sign * reward[k] for k in kids.get(node, []) if out[k] is not None and reward[k] is not None]
        out[node] = best(given) if given else leaf
    return out


TREE = "node bigint, parent bigint, level int, reward double, leaf_value double"


@pytest.mark.parametrize("seed", range(4))
def test_backup_of_long_thin_trees(spark, seed):
    """Chains with short side branches, several roots, some nulls."""
    rng = np.random.default_rng(seed)
    rows, spine = [], []
    for i in range(300):
        parent = None if i == 0 or seed == 3 and i == 150 else spine[-1] if rng.random() < (0.9, 0.6, 0.97, 0.8)[seed] else spine[int(rng.integers(max(0, i - 12), i))]
        level = 0 if parent is None else rows[parent][2] + 1
        number = lambda: None if seed == 2 and rng.random() < 0.1 else float(rng.uniform(-1, 1))
        rows.append((i, parent, level, number(), number()))
        spine.append(i)
    nodes = spark.createDataFrame(rows, TREE).repartition(3)
    made = predictions.backup_tree(nodes)
    assert made.columns == ["node", "parent", "level", "reward", "value"]
    got, want = {r.node: r.value for r in made.collect()}, backed_up(rows)
    assert got.keys() == want.keys()
    assert all((got[n] is None) == (want[n] is None) and (want[n] is None or got[n] == pytest.approx(want[n])) for n in want)
    assert predictions.backup_tree(nodes.limit(0)).count() == 0


def test_backup_of_a_chain_takes_few_rounds(spark, monkeypatch):
    from kifuframe.operators import trees

    stores, store = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df, name: stores.append(name) or store(df, name))
    depth = 50_000
    rows = [(i, i - 1 if i else None, i, (i * 37 % 11 - 5) / 7, 0.25) for i in range(depth)]
    got = {r.node: r.value for r in predictions.backup_tree(spark.createDataFrame(rows, TREE)).collect()}
    want = backed_up(rows)
    assert max(abs(got[n] - want[n]) for n in want) < 1e-6
    assert len(stores) < 40


def test_tree_levels_of_large_ids():
    starts = fixtures.tree_level_starts()

    def walked(node):
        steps = 0
        while node:
            node, steps = (node - 1) // fixtures.TREE_ARITY, steps + 1
        return steps

    for node in [0, 1, 5, 6, 30, 31, 10**10, 7_629_394_531, 7_629_394_530, 2**63 - 1]:
        assert sum(node >= s for s in starts) - 1 == walked(node)
