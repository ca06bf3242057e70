import json

import pytest

from graphloom.schema import GraphError
from graphloom.sources import pull_requests as pr


def test_pages_and_ranges(spark):
    first = [{"filename": "a.py", "status": "modified", "patch": "@@ -5,2 +8,2 @@\n x"}, {"filename": "b.bin", "status": "modified"}]
    second = [{"filename": "n.py", "previous_filename": "o.py", "status": "renamed", "patch": "@@ -3 +4 @@"}, {"filename": "gone.py", "status": "removed", "patch": "@@ -1,3 +0,0 @@"}]
    asked = []

    def get(url, headers):
        asked.append((url, headers.get("Authorization")))
        return (200, '<http://api/2>; rel="next"', json.dumps(first).encode()) if len(asked) == 1 else (200, "", json.dumps(second).encode())

    found = {tuple(r) for r in pr.pull_request_ranges(spark, "http://api/", "o/r", 7, "tok", get).collect()}
    assert found == {("a.py", 5, 6), ("a.py", 8, 9), ("b.bin", 1, 10_000_000), ("n.py", 3, 3), ("n.py", 4, 4), ("o.py", 3, 3), ("gone.py", 1, 3), ("gone.py", 1, 10_000_000)}
    assert asked == [("http://api/repos/o/r/pulls/7/files?per_page=100", "Bearer tok"), ("http://api/2", "Bearer tok")]


@pytest.mark.parametrize("status", [401, 403, 404, 500])
def test_errors(status):
    with pytest.raises(GraphError):
        pr.pages("http://api", "", lambda url, headers: (status, "", b""))
