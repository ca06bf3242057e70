"""WARC archives of pages, and a capture index of two levels over them.

Archives hold a gzip member per record. A payload that comes again is a
``revisit`` of the record with the smallest id, whose block is the HTTP head alone.
The index sorts captures by reversed-host keys (``com,example,www)/path``) into
shards by range; a shard is a file of compressed blocks of lines with a sparse
directory (a row per block) at its end. A lookup finds the shards of a key by
binary search over their bounds, the block by binary search in the directory, the
lines by binary search in the block, and the record by a range read.

Files are named anew by every attempt of a task and are known by the rows of the
attempt that succeeded alone, so a lost executor leaves nothing that is read.

Defined results: a null html is an empty payload; empty payloads are equal
payloads; a null url has the key of an empty text and no target; what is no
address is a path without host; a very long html is one record, written and read
whole; a row without id revisits the smallest id of its payload, and is a response
where its payload comes with no id; rows that repeat an id and its payload can't
be told apart and are responses or revisits alike; an empty table gives no
archives and no rows; other columns of ``pages`` are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, delete, new_path, read, ship, stored
from graphloom.sources.files import store_of

CAPTURES = "url_key string, page_id long, file string, offset long, length long"
SHARDS = "shard int, file string, directory_at long, n_blocks int, n_captures long, first_key string, last_key string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Profile of a revisit whose payload equals an earlier one (fixed value of the format).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters of a shard's bounds that decide to which shards a key goes; what agrees in all of them goes to all that agree.
BOUND_CHARS = 1024
#: Bytes that one range read fetches at least.
READ_AHEAD = 4 << 20


def url_key(url: Column) -> Column:
    """Reversed host, ``)``, path and query. Scheme, user, port and fragment don't count, nor does the host's case."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record of the archive, not compressed yet. ``refers_to`` makes it a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": page_name(page_id), "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f%]", lambda c: f"%{ord(c[0]):02X}", url)
    fields["WARC-Payload-Digest"] = f"sha1:{digest(payload)}"
    if refers_to is not None:
        fields |= {"WARC-Refers-To": page_name(refers_to), "WARC-Profile": SAME_PAYLOAD}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def page_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    found = name[len("<urn:page:") : -1]
    return int(found) if found else None


def parse(data: bytes) -> tuple:
    """A row of ``RECORDS``; a payload that its own digest or length doesn't fit is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    told, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if rest[len(block) :] != b"\r\n\r\n" or kind == "response" and (len(payload) != size or digest(payload) != told):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    url = fields.get("WARC-Target-URI")
    url = None if url is None else re.sub("%([0-9A-F]{2})", lambda c: chr(int(c[1], 16)), url)
    refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(fields["WARC-Record-ID"]), url, kind, refers, size, told, payload if kind == "response" else None


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: payloads of ``least_bytes`` or more that come again refer to the smallest id that has them.

    Payloads are compared by SHA-256 and length. Counts are aggregated before they
    move; only digests that come again are joined, and broadcast when their bytes allow.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("sha", F.unhex(F.sha2("payload", 256))).withColumn("size", F.length("payload"))
    again = rows.filter(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = broadcast_if_small(stored(again.filter("n > 1").drop("n"), "warc-repeated"))
    return rows.join(again, ["sha", "size"], "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Write the rows of :func:`with_revisits` below ``path``, a file a task (or more, from ``file_bytes`` on); returns the stored captures."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = name = None
        at = 0
        for batch in batches:
            found = []
            for key, page_id, url, payload, refers_to in batch.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, bytes(payload), refers_to, date)) + packer.flush()
                if out is None or at and at + len(member) > file_bytes:
                    if out:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = new_file(path, name)
                out.write(member)
                found.append((key, page_id, name, at, len(member)))
                at += len(member)
            yield frame(found, CAPTURES)
        if out:
            out.close()

    # ids cross as nullable integers: a float would round them
    rows = rows.select(url_key(F.col("url")).alias("url_key"), F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))
    return stored(rows.mapInPandas(run, CAPTURES), "warc-captures")


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    fields = [f.split(" ") for f in schema.split(", ")]
    out = pd.DataFrame(rows, columns=[n for n, _ in fields], dtype=object)
    return out.astype({n: "Int64" if t == "long" else "Int32" for n, t in fields if t in ("long", "int")})


def new_file(path: str, name: str):  # noqa: ANN201
    """An output stream of any store that Arrow's file systems reach."""
    store, base = store_of(path)
    store.create_dir(base, recursive=True)
    return store.open_output_stream(f"{base}/{name}", compression=None)


@dataclass
class CaptureIndex:
    """Index files below ``path`` and the table of its shards, of which there are ``max_shards`` at most."""

    path: str
    shards: DataFrame


def build_index(captures: DataFrame, path: str, block_lines: int = 1000, shard_captures: int = 4000, max_shards: int = 4096) -> CaptureIndex:
    """Sort captures by key into shards and write them as blocks of ``block_lines`` lines, each with its directory behind them.

    ``shard_captures`` is what a shard holds about; beyond ``max_shards`` shards grow instead. One key's captures may lie in many blocks and shards.
    """
    ship(captures.sparkSession)
    n = max(1, min(max_shards, -(-captures.count() // shard_captures)))
    keys = ["url_key", "page_id", "file", "offset"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, at, total = None, f"index-{uuid.uuid4().hex}", 0, 0
        directory: list[tuple[str, int, int]] = []
        lines: list[tuple] = []
        last = ""

        def flush() -> None:
            nonlocal at, out, last
            out = out or new_file(path, name)
            data = zlib.compress("\n".join(map(json.dumps, lines)).encode())
            out.write(data)
            directory.append((lines[0][0], at, len(data)))
            at, last = at + len(data), lines[-1][0]
            lines.clear()

        for batch in batches:
            for key, page_id, file, offset, length in batch.itertuples(index=False):
                lines.append((key, page_id, file, int(offset), int(length)))
                total += 1
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out:
            out.write(zlib.compress(json.dumps(directory).encode()))
            out.close()
            yield frame([(0, name, at, len(directory), total, directory[0][0], last)], SHARDS)

    rows = captures.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("page_id", F.col("page_id").cast("string"))
    shards = stored(rows.mapInPandas(run, SHARDS), "warc-shards")
    return CaptureIndex(path, shards)


def lookup(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """Captures of the distinct ``url_key`` of ``keys``. Keys go to their shards, where each is looked up by two binary searches and range reads.

    The driver and each task hold the bounds of the shards, at most ``max_shards`` pairs of ``BOUND_CHARS`` characters; a task holds one directory and one block.
    """
    ship(keys.sparkSession)
    bounds = index.shards.select("file", "directory_at", F.substring("first_key", 1, BOUND_CHARS).alias("a"), F.substring("last_key", 1, BOUND_CHARS).alias("z"))
    bounds = sorted(map(tuple, bounds.collect()), key=lambda b: (b[2], b[3]))
    firsts, lasts = [b[2] for b in bounds], [b[3] for b in bounds]
    places = [(b[0], b[1]) for b in bounds]
    path = index.path

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            short = [k[:BOUND_CHARS] for k in batch["url_key"]]
            spans = [range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k)) for k in short]
            yield pd.DataFrame([(k, s, *places[s]) for k, span in zip(batch["url_key"], spans, strict=True) for s in span], columns=["url_key", "shard", "file", "directory_at"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = handle = None
        directory: list = []
        starts: list[str] = []
        held, block = None, []
        for batch in batches:
            found = []
            for key, _, file, directory_at in batch.itertuples(index=False):
                if file != name:
                    if handle:
                        handle.close()
                    store, base = store_of(path)
                    name, handle, held = file, store.open_input_file(f"{base}/{file}"), None
                    handle.seek(directory_at)
                    directory = json.loads(zlib.decompress(handle.read()))
                    starts = [d[0] for d in directory]
                b = max(0, bisect.bisect_left(starts, key) - 1)  # the key may begin at the end of the block before its first start
                while b < len(starts) and starts[b] <= key:
                    if held != b:
                        handle.seek(directory[b][1])
                        held, block = b, [json.loads(x) for x in zlib.decompress(handle.read(directory[b][2])).split(b"\n")]
                    i = bisect.bisect_left(block, key, key=lambda x: x[0])
                    while i < len(block) and block[i][0] == key:
                        found.append((key, None if block[i][1] is None else int(block[i][1]), *block[i][2:]))
                        i += 1
                    b += 1
                if len(found) >= 10_000:
                    yield frame(found, CAPTURES)
                    found = []
            yield frame(found, CAPTURES)
        if handle:
            handle.close()

    routed = keys.select("url_key").distinct().mapInPandas(route, "url_key string, shard int, file string, directory_at long")
    return routed.repartition("shard").sortWithinPartitions("shard", "url_key").mapInPandas(search, CAPTURES)


def read_records(captures: DataFrame, path: str, task_bytes: int = 8 << 20, max_tasks: int = 20_000) -> DataFrame:
    """Records of stored captures by range reads, in the order of the files, so that neighbours come with one read. A worker holds one read and records of about as many bytes, or a single longer one."""
    spark = captures.sparkSession
    ship(spark)
    tasks = max(1, min(max_tasks, -(-(captures.agg(F.sum("length")).first()[0] or 0) // task_bytes)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = handle = None
        data, begin, found, held = b"", 0, [], 0
        for batch in batches:
            for file, offset, length in batch.itertuples(index=False):
                if file != name:
                    if handle:
                        handle.close()
                    store, base = store_of(path)
                    name, handle, data = file, store.open_input_file(f"{base}/{file}"), b""
                if not begin <= offset <= offset + length <= begin + len(data):
                    handle.seek(offset)
                    data, begin = handle.read(max(length, READ_AHEAD)), offset
                member = data[offset - begin : offset - begin + length]
                found.append(parse(zlib.decompress(member, 31)))
                held += found[-1][4]
                if held >= READ_AHEAD or len(found) == 1000:
                    yield frame(found, RECORDS)
                    found, held = [], 0
        yield frame(found, RECORDS)
        if handle:
            handle.close()

    rows = captures.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / task_bytes)).sortWithinPartitions("file", "offset")
    return rows.mapInPandas(run, RECORDS)


def op11_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all ``pages``, index the captures, look up every page's address and read its records back."""
    pages = read(spark, sf_dir, "pages")
    path = new_path(spark, "warc")
    captures = write_archives(with_revisits(pages), f"{path}/archives")
    index = build_index(captures, f"{path}/index")
    found = stored(lookup(index, pages.select(url_key(F.col("url")).alias("url_key"))), "warc-found")
    out = read_records(found, f"{path}/archives").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    out = stored(out, "warc-records")
    delete(spark, path)  # what was read is stored
    return out


#: Base 32 of a digest: five hexadecimal digits are four characters.
OP11_SQL = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, string_split(sha1(coalesce(html, '')), '') AS h FROM pages),
words AS (SELECT *, list_transform(range(8), lambda g: list_reduce(list_transform(range(5), lambda i: (instr('0123456789abcdef', h[5 * g + i + 1]) - 1)::BIGINT), lambda a, b: a * 16 + b)) AS w FROM sized),
named AS (
  SELECT page_id, body, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest
  FROM words),
firsts AS (SELECT body, min(page_id) AS first FROM named GROUP BY body)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM named JOIN firsts USING (body)
"""
