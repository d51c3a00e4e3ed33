import json
import os
import time

import pytest

from carelens.streaming import stream
from carelens.streaming.entries import posts_with_users, read_entries


def at(minutes):
    return f"2020-01-01T{minutes // 60:02}:{minutes % 60:02}:00Z"


def user(i):
    return {"id": str(i), "username": f"u{i}"}


def post(i, author, minutes):
    return {"id": f"p{i}", "author_id": author and str(author), "text": f"text {i}", "at": at(minutes)}


def land(folder, *files):
    """Files of entries, in the order of their arrival."""
    os.makedirs(f"{folder}/in")
    for i, rows in enumerate(files):
        with open(f"{folder}/in/{i:03}.json", "w") as f:
            f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        os.utime(f"{folder}/in/{i:03}.json", (time.time() - 100 + i,) * 2)
    return f"{folder}/in"


END = ([{"newest_id": "e", "at": at(600)}], [{"newest_id": "e", "at": at(601)}])


def run(spark, path, per_trigger=1):
    out = stream.run_to_parquet(posts_with_users(read_entries(spark, path, per_trigger), "1 hour", "10 minutes"), "e")
    return sorted((r.id, r.user and r.user.username) for r in out.collect())


def test_late_users_are_attached_and_paging_is_skipped(spark, tmp_path):
    path = land(tmp_path,
                [post(1, 1, 0), post(2, 2, 1), post(3, 3, 1), {"newest_id": "p3", "at": at(1)}],
                [{"users": [user(1)], "at": at(5)}, {"newest_id": "p3", "at": at(5)}, post(4, None, 6)],
                ["", {"users": [user(2), user(1), user(1)], "at": at(22)}, post(5, 1, 30)],
                [{"users": [], "at": at(40)}, post(6, 9, 41)], *END)
    want = [("p1", "u1"), ("p2", "u2"), ("p3", None), ("p4", None), ("p5", "u1"), ("p6", None)]
    assert run(spark, path) == want


def test_users_after_the_wait_are_too_late(spark, tmp_path):
    path = land(tmp_path, [post(1, 1, 0)], [post(2, 1, 150)], [{"users": [user(1)], "at": at(160)}], *END)
    assert run(spark, path) == [("p1", None), ("p2", "u1")]


@pytest.mark.parametrize("entry", ['{"meta": 1}', "no json", '{"text": "no id"}'])
def test_an_unknown_entry_raises(spark, tmp_path, entry):
    path = land(tmp_path, [post(1, 1, 0)], [entry], *END)
    with pytest.raises(Exception, match="unknown entry"):
        run(spark, path)


def test_an_entry_without_a_time_takes_that_of_its_file(spark, tmp_path):
    path = land(tmp_path, [{"id": "p1", "author_id": "1"}], [{"users": [user(1)]}])
    rows = read_entries(spark, path, streaming=False).orderBy("at").collect()
    assert [r.kind for r in rows] == ["post", "users"] and rows[0].at < rows[1].at
    assert run(spark, path) == [("p1", "u1")]
