"""Isolation forest and log detector."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultloom.operators import evaluate, forest, logs
from faultloom.operators.models import KpiDetector, LogDetector


def test_mean_path():
    assert forest.mean_path(1) == 0 and forest.mean_path(2) == 1
    assert float(forest.mean_path(256)) == pytest.approx(10.244770920116851)


def depth_by_walk(nodes, point):
    node = nodes.loc[0]
    while node["feature"] >= 0:
        side = "left" if point[int(node["feature"])] <= node["cut"] else "right"
        node = nodes.loc[int(node[side])]
    return node["path"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"id": range(2000), "x": rng.normal(size=2000), "y": rng.normal(size=2000)})
    data.loc[:9, ["x", "y"]] += 8
    data["label"] = (data["id"] < 10).astype(int)
    return spark.createDataFrame(data)


def test_forest_finds_outliers_and_matches_a_plain_walk(points):
    model = forest.IsolationForest(("x", "y"), trees=30, sample=128).fit(points, ["id"])
    scored = model.transform(points)
    assert evaluate.roc_auc_score(scored, "label") > 0.99
    trees = [t.set_index("node") for _, t in model.nodes.groupby("tree")]
    assert len(trees) == 30
    for r in scored.where("id % 400 = 3").collect():
        mean = np.mean([depth_by_walk(t, (r["x"], r["y"])) for t in trees])
        want = 2 ** (-mean / float(forest.mean_path(model.sample)))
        assert r["score"] == pytest.approx(want)


def test_forest_on_one_feature(points):
    model = forest.IsolationForest(("x",), trees=5, sample=32).fit(points, ["id"])
    top = model.transform(points).orderBy(F.col("score").desc()).limit(5).collect()
    assert all(abs(r["x"]) > 2 for r in top)


def test_forest_does_not_depend_on_partitioning(points):
    grow = forest.IsolationForest(("x", "y"), trees=5, sample=64)
    a = grow.fit(points.repartition(7), ["id"]).nodes
    b = grow.fit(points.coalesce(1), ["id"]).nodes
    pd.testing.assert_frame_equal(
        a.sort_values(["tree", "node"], ignore_index=True),
        b.sort_values(["tree", "node"], ignore_index=True))


def test_small_tables_are_dealt_out_repeatedly(points):
    drawn = forest.IsolationForest(("x",), trees=8, sample=16).draw(points.limit(20), ["id"])
    sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 20 * 7


def test_empty_training_table(points):
    with pytest.raises(ValueError):
        forest.IsolationForest(("x",), trees=3).fit(points.limit(0), ["id"])


def test_kpi_detector_tunes_its_threshold(points):
    detector = KpiDetector(("x", "y"), ("id",), trees=20)
    tuned = detector.fit(points, label="label")
    report = evaluate.classification_report(
        tuned.transform(points), "label", "prediction").first()
    assert report["f1"] > 0.9
    assert detector.fit(points).threshold == 0.6


def test_log_detector(spark):
    rows = [(f"b{i}", i % 5 + (20 if i % 4 == 0 else 0), i % 3, int(i % 4 == 0))
            for i in range(200)]
    matrix = spark.createDataFrame(rows, "block_id string, E1 int, E2 int, label int")
    model = LogDetector(("E1", "E2"), trees=5).fit(matrix)
    scored = model.transform(matrix)
    assert scored.columns == ["block_id", "E1", "E2", "label", "score", "prediction"]
    assert evaluate.classification_report(scored, "label", "prediction").first()["f1"] == 1.0
    tuned = LogDetector(("E1", "E2"), trees=3).tune(matrix, depths=(1, 3), folds=2)
    assert evaluate.roc_auc_score(tuned.transform(matrix), "label") == 1.0


TRACES = [("b1", ["E1", "E2", "E1", "E2", "E1"]), ("b2", ["E1", "E2", "E1", "E3"]), ("b3", [])]


@pytest.fixture(scope="module")
def events(spark):
    return logs.explode_traces(
        spark.createDataFrame(TRACES, "block_id string, trace array<string>"))


def test_sequences_keep_every_event(events):
    rows = logs.log_sequences(events, ["position"], segment=2, rows_per_slice=2)
    found = {(r["block_id"], r["segment"]): r["events"] for r in rows.collect()}
    assert found == {
        ("b1", 0): ["E1", "E2"], ("b1", 1): ["E1", "E2"], ("b1", 2): ["E1"],
        ("b2", 0): ["E1", "E2"], ("b2", 1): ["E1", "E3"]}


def test_windows_and_misses(events):
    windows = logs.log_windows(events, ["position"], history=2, rows_per_slice=2)
    found = {(r["block_id"], r["position"], tuple(r["history"]), r["next_event"])
             for r in windows.collect()}
    assert found == {
        ("b1", 3, ("E1", "E2"), "E1"), ("b1", 4, ("E2", "E1"), "E2"),
        ("b1", 5, ("E1", "E2"), "E1"), ("b2", 3, ("E1", "E2"), "E1"),
        ("b2", 4, ("E2", "E1"), "E3")}
    misses = logs.next_event_misses(windows, logs.likely_next(windows, top=1))
    assert {tuple(r) for r in misses.collect()} == {("b1", 0, 0), ("b2", 1, 1)}


def test_matrix_and_checks(spark, events):
    rows = {r["block_id"]: tuple(r)[1:] for r in
            logs.occurrence_matrix(events, ["E1", "E2", "E9"]).collect()}
    assert rows == {"b1": (3, 2, 0), "b2": (2, 1, 0)}
    labels = spark.createDataFrame(
        [("b1", "Normal"), ("b1", "Normal"), ("b4", "odd"), (None, None)],
        "block_id string, label string")
    checks = {r["check"]: r["violations"] for r in
              logs.log_quality_checks(labels, events).collect()}
    assert checks == {
        "label_block_present": 1, "label_block_unique": 1, "label_present": 1, "label_values": 1,
        "event_block_present": 0, "event_present": 0, "event_block_labelled": 1}
    assert events.agg(F.count(F.lit(1))).first()[0] == 9


def test_tuning_grows_and_scores_every_forest_at_once(points):
    """The areas and the model are those of forests fitted one by one; reruns and partitions do not matter."""
    grown = forest.IsolationForest(("x", "y"), seed=3)
    grid = [(3, 16), (20, 128), (3, 16), (10, 4096)]
    model, areas = grown.tune(points.repartition(5), ["id"], "label", grid)
    again, same = grown.tune(points, ["id"], "label", grid)
    areas = {(r["trees"], r["sample"]): r["auc"] for r in areas.collect()}
    assert areas == {(r["trees"], r["sample"]): r["auc"] for r in same.collect()} and len(areas) == 3
    order = ["tree", "node"]
    for (trees, sample), auc in areas.items():
        alone = forest.IsolationForest(("x", "y"), trees=trees, sample=sample, seed=3).fit(points, ["id"])
        assert evaluate.roc_auc_score(alone.transform(points), "label") == pytest.approx(auc)
        if auc == max(areas.values()) and alone.sample == model.sample:
            pd.testing.assert_frame_equal(
                model.nodes.sort_values(order, ignore_index=True)[alone.nodes.columns],
                alone.nodes.sort_values(order, ignore_index=True))
    pd.testing.assert_frame_equal(
        model.nodes.sort_values(order, ignore_index=True), again.nodes.sort_values(order, ignore_index=True))


def test_tuning_without_both_classes_keeps_the_first_pair(points):
    model, areas = forest.IsolationForest(("x", "y")).tune(points.where("label = 0"), ["id"], "label", [(2, 8), (3, 8)])
    assert model.nodes["tree"].nunique() == 2 and all(r["auc"] is None for r in areas.collect())


def test_unseen_histories_back_off(spark):
    """Against a plain count of every suffix, with NULL events and blocks shorter than the history."""
    rng = np.random.default_rng(5)
    kinds = ["a", "b", "c", None]
    learnt = [(f"k{b}", i, kinds[int(rng.integers(4))]) for b in range(20) for i in range(int(rng.integers(1, 15)))]
    fresh = learnt[:40] + [("new", i, e) for i, e in enumerate(["z", "a", None, "b", "z", "z"])]
    schema = "block_id string, position int, event string"

    def windows(rows):
        return logs.log_windows(spark.createDataFrame(rows, schema), ["position"], history=3, full=False)

    def plain(rows):
        blocks = {}
        for block, _, event in rows:
            blocks.setdefault(block, []).append(event)
        return [(b, tuple(es[max(0, i - 3):i]), e) for b, es in blocks.items() for i, e in enumerate(es)]

    counts = {}
    for _, h, e in plain(learnt):
        for k in range(len(h) + 1):
            at = counts.setdefault(h[len(h) - k:], {})
            at[e] = at.get(e, 0) + 1
    want = {}
    for block, h, e in plain(fresh):
        ends = [h[k:] for k in range(len(h) + 1) if sum(counts.get(h[k:], {}).values()) >= 2]
        top = sorted(counts[ends[0]].items(), key=lambda c: (-c[1], c[0] is not None, c[0] or ""))[:2]
        misses, short = want.get(block, (0, 0))
        want[block] = (misses + (e not in [t for t, _ in top]), short + (len(ends[0]) < len(h)))
    got = logs.backed_off_misses(windows(fresh), logs.context_table(windows(learnt), seen=2), tolerated=1).collect()
    assert {r["block_id"]: (r["misses"], r["backed_off"]) for r in got} == want
    assert all(r["flagged"] == (r["misses"] > 1) for r in got) and want["new"][1] > 0
    none = logs.backed_off_misses(windows(fresh), logs.context_table(windows(learnt).limit(0)))
    assert all(r["misses"] == r["backed_off"] for r in none.collect())
