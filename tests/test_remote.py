"""Pages, retries and cached answers with services that fail on purpose."""

import pytest

from korpusverk.sources import remote


def test_retries_wait_longer_each_time():
    waits, left = [], [ValueError(), remote.Busy(), ValueError()]

    def call(x):
        if left:
            raise left.pop(0)
        return x * 2

    assert remote.patient(call, sleep=waits.append)(4) == 8 and waits == [1.0, 30.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        remote.patient(lambda: 1 // 0, tries=2, sleep=waits.append)()


def test_pages_end_where_the_cursor_stalls(spark, tmp_path):
    posts = [{"id": i, "at": i // 2} for i in range(40)]

    def fetch(before):
        return sorted((p for p in posts if before is None or p["at"] <= before), key=lambda p: -p["at"])[:7]

    got = remote.paged_table(spark, fetch, "at", "id", "id bigint, at bigint", str(tmp_path / "t"), batch=2)
    assert {r["id"] for r in got.collect()} == {p["id"] for p in posts} and got.count() == 40
    assert remote.paged_table(spark, lambda before: [], "at", "id", "id bigint, at bigint", str(tmp_path / "e")).count() == 0


def test_only_open_questions_are_asked(spark):
    todo = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    done = spark.createDataFrame([(1, "AI"), (2, "UNKNOWN")], "id int, predicted string")
    got = remote.answered(todo, done, ["id"], lambda rows: [{"id": r["id"], "predicted": r["t"].upper()} for r in rows], "id int, predicted string", "predicted")
    assert sorted(map(tuple, got.collect())) == [(2, "B"), (3, "C")]
