"""Commits by optimistic concurrency: no number twice, no commit lost."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest

from martlet.session import scratch_path
from martlet.sinks import commits
from martlet.sinks import publish as sink


def test_a_number_is_created_once(spark):
    folder = scratch_path(spark, "once")
    assert commits.newest(spark, folder) == (0, {})
    assert commits.create(spark, folder, 1, {"a": 1}) is True
    assert commits.create(spark, folder, 1, {"a": 2}) is False
    assert commits.newest(spark, folder) == (1, {"a": 1})


@pytest.mark.parametrize("put", [commits._link, commits._rename])
def test_both_ways_refuse_a_taken_name(spark, put):
    folder = scratch_path(spark, "ways")
    commits._fs(spark, folder)[0].mkdirs(commits._fs(spark, folder)[1])
    target = f"{folder}/commit-000000000001.json"
    assert put(spark, f"{folder}/.draft-1", target, '{"who": 1}')
    assert not put(spark, f"{folder}/.draft-2", target, '{"who": 2}')
    assert commits.read(spark, folder, 1) == {"who": 1} and commits.numbers(spark, folder) == [1]


def test_writers_at_once_lose_nothing(spark):
    folder, writers, each = scratch_path(spark, "race"), 6, 5
    start = Barrier(writers)

    def write(w):
        start.wait()
        return [commits.commit(spark, folder, lambda n, state, i=i: state | {f"{w}-{i}": n}) for i in range(each)]

    with ThreadPoolExecutor(writers) as pool:
        got = [n for made in pool.map(write, range(writers)) for n in made]
    assert sorted(got) == list(range(1, writers * each + 1))
    state = commits.newest(spark, folder)[1]
    assert len(state) == writers * each and sorted(state.values()) == sorted(got)


def test_a_writer_that_lost_starts_from_the_newer_state(spark):
    folder = scratch_path(spark, "lost")
    seen = []

    def change(number, state):
        seen.append((number, dict(state)))
        if len(seen) == 1:                      # another writer gets in between
            assert commits.create(spark, folder, number, {"other": number})
        return state | {"mine": number}

    assert commits.commit(spark, folder, change) == 2
    assert seen == [(1, {}), (2, {"other": 1})]
    assert commits.newest(spark, folder) == (2, {"other": 1, "mine": 2})


def test_two_publishers_at_once_keep_both_sets(spark):
    root, start = scratch_path(spark, "two-publishers"), Barrier(2)

    def run(name):
        stager = sink.Stager(spark, root)
        for table in (name, "shared"):
            stager.stage(table, spark.range(3 if name == "left" else 5).toDF("n"))
        start.wait()
        stager.commit()
        return stager

    with ThreadPoolExecutor(2) as pool:
        left, right = pool.map(run, ("left", "right"))
    assert {left.number, right.number} == {1, 2} and sink.last_commit(spark, root) == 2
    marts = {n: df.count() for n, df in sink.read_marts(spark, root, ["left", "right", "shared"]).items()}
    later = left if left.number == 2 else right
    assert marts == {"left": 3, "right": 5, "shared": 3 if later is left else 5}
    assert sink.current_versions(spark, root)["shared"]["version"] == later.version
