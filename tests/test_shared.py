"""Intermediate tables and who deletes them."""

import threading
from pathlib import Path

from gridloom.functions import ranks, shared


def tables(spark):
    folder = Path(shared.shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "gridloom"
    return set(folder.iterdir()) if folder.exists() else set()


def test_a_scope_deletes_what_was_made_inside_it(spark):
    before = tables(spark)
    with shared.intermediates(spark):
        rows = shared.written(spark.range(10))
        with shared.intermediates(spark):
            assert shared.written(rows).count() == 10
            assert len(tables(spark) - before) == 2
        assert len(tables(spark) - before) == 1 and rows.count() == 10
        assert ranks.running(rows, ["id"]).count() == 10
    assert tables(spark) == before


def test_scopes_of_threads_are_apart(spark):
    before, begun, done, left = tables(spark), threading.Event(), threading.Event(), []

    def other():
        with shared.intermediates(spark):
            mine = shared.written(spark.range(5))
            begun.set()
            done.wait(60)
            left.append(mine.count())

    thread = threading.Thread(target=other)
    with shared.intermediates(spark):
        thread.start()
        begun.wait(60)
        shared.written(spark.range(3)).count()
    done.set()
    thread.join(60)
    assert left == [5] and tables(spark) == before


def test_a_failure_deletes_too(spark):
    before = tables(spark)
    try:
        with shared.intermediates(spark):
            shared.written(spark.range(2))
            raise KeyError
    except KeyError:
        pass
    assert tables(spark) == before


def test_numbering_clashes_with_no_column(spark):
    rows = spark.createDataFrame([(3, 1, 1, 1, 1), (1, 2, 2, 2, 2), (2, 3, 3, 3, 3)], "id int, _range int, _n int, _first int, `a.b``_sum` int")
    got = ranks.running(rows, ["id"], add="_n").orderBy("id").collect()
    assert [(r["id"], r["_range"], r["place"], r["before"]) for r in got] == [(1, 2, 0, 0), (2, 3, 1, 2), (3, 1, 2, 5)]
