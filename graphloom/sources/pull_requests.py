"""Changed ranges of a pull request, from its paginated list of files."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.schema import PullRequestError
from graphloom.sources.diffs import WHOLE_FILE, changed_ranges, parse_diff

#: An answer: status, the link header, the body.
Get = Callable[[str, dict[str, str]], tuple[int, str, bytes]]
TIMEOUT_SECONDS = 30
REASONS = {401: "the token isn't accepted", 403: "access is refused or the rate limit is reached", 404: "not found, or not visible with this token"}


def http_get(url: str, headers: dict[str, str]) -> tuple[int, str, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT_SECONDS) as answer:
            return answer.status, answer.headers.get("Link", ""), answer.read()
    except urllib.error.HTTPError as e:
        return e.code, "", e.read()
    except OSError as e:
        raise PullRequestError(f"{url}: {e}") from e


def pages(url: str, token: str, get: Get = http_get) -> list[dict]:
    """All items of a paginated list, following its links to the next page."""
    headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    out, at = [], url
    while at:
        status, link, body = get(at, headers)
        if status != 200:
            raise PullRequestError(f"{url}: {REASONS.get(status, f'status {status}')}")
        out += json.loads(body)
        following = re.search(r'<([^>]+)>\s*;\s*rel="next"', link)
        at = following[1] if following else None
    return out


def file_ranges(spark: SparkSession, files: list[dict]) -> DataFrame:
    """path, start, end of a list of changed files; a file without a patch is changed as a whole."""
    lines, whole = [], []
    for f in files:
        path, old = f["filename"], f.get("previous_filename") or f["filename"]
        if not f.get("patch"):
            whole.append((path, 1, WHOLE_FILE))
            continue
        old = "/dev/null" if f.get("status") == "added" else f"a/{old}"
        new = "/dev/null" if f.get("status") == "removed" else f"b/{path}"
        lines += [(path, i, x) for i, x in enumerate([f"--- {old}", f"+++ {new}", *f["patch"].splitlines()])]
    diff = parse_diff(spark.createDataFrame(lines, "file string, ord long, line string"), by="file")
    return changed_ranges(diff, "file").drop("file").unionByName(spark.createDataFrame(whole, "path string, start int, end int"))


def pull_request_ranges(spark: SparkSession, api: str, repo: str, number: int, token: str = "", get: Get = http_get) -> DataFrame:
    return file_ranges(spark, pages(f"{api.rstrip('/')}/repos/{repo}/pulls/{number}/files?per_page=100", token, get))
