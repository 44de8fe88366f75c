"""Inverted vector lists against exact search: recall, ties, full lists, odd vectors, saved indexes."""

import numpy as np
import pytest

from claimtrace.operators import ivf
from claimtrace.operators.vectors import vector_topk
from tests.oracle import spark_rows

VECTOR = "id bigint, vector array<double>"


def _vectors(spark, matrix, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(matrix)], VECTOR)


@pytest.fixture(scope="module")
def clustered(spark):
    """1,500 vectors around 30 directions, one of which a third of them share."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    which = np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 30, 1500))
    return _vectors(spark, centres[which] + 0.3 * rng.standard_normal((1500, 16))).cache()


def _recall(found, exact):
    row = ivf.recall_at(found, exact).first()
    return row.n_found / row.n_neighbours


def test_recall_is_reached_with_a_part_of_the_lists(spark, clustered):
    index = ivf.build_ivf(clustered, 10)
    assert index.rows.count() == 1500
    assert index.probes < len(index.centres) / 2
    queries = _vectors(spark, np.random.default_rng(4).standard_normal((40, 16)), 10_000)
    for asked in (clustered, queries):
        wanted = 0.9 if asked is clustered else 0.8
        assert _recall(ivf.ivf_topk(index, asked, 10), vector_topk(clustered, asked, 10)) >= wanted


def test_all_lists_give_the_exact_result(spark, clustered, monkeypatch):
    index = ivf.build_ivf(clustered, 5, lists=20)
    exact = spark_rows(vector_topk(clustered, clustered, 5))
    assert spark_rows(ivf.ivf_topk(index, clustered, 5, probes=len(index.centres))) == exact
    # lists dealt over many small cells
    monkeypatch.setattr(ivf, "CELL_BYTES", 8 * 16 * 50)
    assert spark_rows(ivf.ivf_topk(index, clustered, 5, probes=len(index.centres))) == exact


def test_saved_index(spark, clustered, tmp_path):
    index = ivf.build_ivf(clustered, 5, lists=20)
    ivf.save_ivf(index, str(tmp_path / "index"))
    again = ivf.load_ivf(spark, str(tmp_path / "index"))
    assert again.probes == index.probes and np.array_equal(again.centres, index.centres)
    asked = clustered.where("id % 50 = 0")
    assert spark_rows(ivf.ivf_topk(again, asked, 5)) == spark_rows(ivf.ivf_topk(index, asked, 5))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0]), (6, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, VECTOR)
    index = ivf.build_ivf(frame, 2)
    found = ivf.ivf_topk(index, frame, 2, probes=len(index.centres))
    assert spark_rows(found) == spark_rows(vector_topk(frame, frame, 2))
    assert ivf.ivf_topk(ivf.build_ivf(frame.limit(0), 2), frame, 2).count() == 0
    for few in (frame.where("id = 1"), frame.where("id = 3")):
        small = ivf.build_ivf(few, 2)
        assert ivf.ivf_topk(small, frame, 2, probes=len(small.centres)).count() == vector_topk(few, frame, 2).count()
    with pytest.raises(Exception, match="not a vector of 2 numbers"):
        ivf.build_ivf(spark.createDataFrame([*rows, (9, [1.0])], VECTOR), 2)


def test_a_query_is_copied_by_groups_of_lists(clustered, monkeypatch):
    """Copies grew with the lists that a query looks into, faster than the vectors."""
    index = ivf.build_ivf(clustered, 5, lists=40)
    sent = []
    place = ivf._asked
    monkeypatch.setattr(ivf, "_asked", lambda *args: sent.append(place(*args)) or sent[-1])
    for rows, groups in ((ivf.CELL_ROWS, 1), (400, 12)):
        monkeypatch.setattr(ivf, "CELL_ROWS", rows)
        for probes in (10, len(index.centres)):
            assert ivf.ivf_topk(index, clustered, 5, probes=probes).count() == 1500 * 5
            n = sent[-1].count()
            assert 1500 <= n <= 1500 * groups
            assert sent[-1].select("id", "__g").distinct().count() == n


def test_groups_of_lists_are_bounded():
    sizes = np.array([0, 3, 4, 20, 0, 9, 1, 10, 11, 2, 0])
    group, parts = ivf._grouped(sizes, 10)
    spans = ivf._spans(group, parts)
    for i, n in enumerate(sizes):
        assert all(low <= i < high for low, high in spans[group[i] : group[i] + parts[i]]) and n <= 10 * parts[i]
    for g, (low, high) in enumerate(spans):
        assert high > low and (sizes[low:high] / parts[low:high]).sum() <= 10
        assert all(group[i] <= g < group[i] + parts[i] for i in range(low, high))


def test_centres_are_trained_in_many_tasks(clustered, monkeypatch):
    """The sample lay in one partition, and each iteration compared all centres in a task a centre."""
    kept, write = {}, ivf.written
    monkeypatch.setattr(ivf, "written", lambda rows, name: kept.setdefault(name, write(rows, name)))
    tracker = clustered.sparkSession.sparkContext.statusTracker()
    context = clustered.sparkSession.sparkContext
    context.setJobGroup("ivf-trained", "centres")
    try:
        ivf.build_ivf(clustered, 5, lists=700)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert kept["ivf-sample"].rdd.getNumPartitions() > 1
    jobs = [tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup("ivf-trained")]
    stages = [tracker.getStageInfo(i) for job in jobs if job for i in job.stageIds]
    assert stages and max(s.numTasks for s in stages if s) < 100


def test_cells_give_every_core_work(clustered, monkeypatch):
    monkeypatch.setattr(ivf, "_side", lambda rows, queries, found, most: min(most, 200))
    index = ivf.build_ivf(clustered, 5, lists=40)
    found = ivf.ivf_topk(index, clustered, 5)
    monkeypatch.undo()
    assert spark_rows(found) == spark_rows(ivf.ivf_topk(index, clustered, 5))


def test_centres_of_opposite_directions(spark):
    rows = _vectors(spark, [[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0]])
    index = ivf.build_ivf(rows, 1)
    assert spark_rows(ivf.ivf_topk(index, rows, 1, probes=len(index.centres))) == spark_rows(vector_topk(rows, rows, 1))


def test_recall_counts_each_neighbour_once(spark):
    """A pair that was found twice made two neighbours of each in the exact result."""
    exact = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 1)], "query_id bigint, doc_id bigint")
    found = spark.createDataFrame([(1, 2), (1, 2), (4, 1), (4, 5)], "query_id bigint, doc_id bigint")
    assert tuple(ivf.recall_at(found, exact).first()) == (2, 4, 3)
