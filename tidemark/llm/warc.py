"""A deterministic sharded WARC writer, and its reader.

Shards are ranges of the record key, cut by bytes from a histogram, and of the digest within a key of very many bytes, so
they depend on the records alone. Each shard is
sorted by key and written as gzip members, one a record, into files that roll at a compressed size. Headers, record ids
and digests are made anew from the record. A file is written under a name of its own attempt and renamed when whole; the
shard's manifest, itself renamed into place last, names its files. Readers take what the manifests name, so files of
attempts that were lost don't count, and a task that is run again writes the same bytes under the same names.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut, discard, scratch, ship

#: A repeated payload of fewer bytes is written again.
REVISIT_BYTES = 100
#: Records carry no clock: one date makes reruns agree.
DATE = "2024-01-01T00:00:00Z"
CONTROL = re.compile("[\x00-\x1f\x7f-\x9f\u2028\u2029]")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(key: int, ordinal: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}:{ordinal}')}>"


def header_value(value: str) -> str:
    """Control characters and line separators percent-encoded, so that a value can't end its header or begin another."""
    return CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def record(key: int, ordinal: int, url: str, payload: bytes, size: int, digest: str, refers: int | None) -> bytes:
    """The bytes of one record; a revisit (``refers`` given) has no payload but names its size and digest."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, ordinal)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{digest if refers is None else hashlib.sha256(b'').hexdigest()}",
        f"X-Key: {key}",
        f"X-Payload-Length: {size}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: {record_id(refers)}", f"X-Refers-To-Key: {refers}", f"WARC-Profile: {PROFILE}"]
    body = payload if refers is None else b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a decompressed archive."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"a record at byte {at} is cut short")
        yield headers, block
        at = end + 8 + size


def members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The members of a gzip stream, one in memory at a time."""
    unpacker, parts = None, []
    while piece := stream.read(chunk):
        while piece:
            if unpacker is None:
                unpacker, parts = zlib.decompressobj(31), []
            parts.append(unpacker.decompress(piece))
            piece = unpacker.unused_data if unpacker.eof else b""
            if unpacker.eof:
                yield b"".join(parts)
                unpacker = None
    if unpacker is not None:
        raise ValueError("an archive is cut short")


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _commit(fs: pafs.FileSystem, temp: str, name: str) -> None:
    """Rename into place. Where another attempt of the task was first its bytes are the same and stay; some stores don't rename onto a file."""
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        try:
            return fs.move(temp, name)
        except OSError:
            if fs.get_file_info(name).type == pafs.FileType.NotFound:
                raise
    return fs.delete_file(temp)


def _writer(folder: str, roll: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        task = TaskContext.get()
        attempt = f"{task.taskAttemptId() if task else 0}"
        shard = None
        files: list[dict] = []
        out, temp = None, ""
        now: dict = {}
        last: tuple | None = None
        result = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                name = f"shard-{shard:08d}-{len(files):05d}.warc.gz"
                _commit(fs, temp, f"{base}/{name}")
                files.append({"name": name} | now)
                out = None

        def commit() -> None:
            close()
            if shard is not None:
                body = json.dumps({"shard": shard, "files": files}, sort_keys=True).encode()
                mark = f"{base}/.{attempt}-shard-{shard:08d}.json"
                with fs.open_output_stream(mark) as f:
                    f.write(body)
                _commit(fs, mark, f"{base}/shard-{shard:08d}.json")
                result.extend((shard, f["name"], f["records"], f["bytes"]) for f in files)

        pending: dict | None = None  # the narrow row that names the payload to come
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                s, key, digest, kind = cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i].as_py(), cols[3][i].as_py()
                if kind == 0:
                    pending = {"key": key, "digest": digest, "refers": cols[6][i].as_py()}
                    continue
                if s != shard:
                    commit()
                    shard, files, out, last = s, [], None, None
                payload = cols[5][i].as_py() or b""
                if pending is None or (pending["key"], pending["digest"]) != (key, digest):
                    raise ValueError(f"no plan for record {key}")
                refers = pending["refers"]
                ordinal = last[2] + 1 if last and last[:2] == (key, digest) else 0
                last = (key, digest, ordinal)
                size = len(payload)
                if refers is not None and refers == key and ordinal == 0:
                    refers = None
                if out is None:
                    temp = f"{base}/.{attempt}-{shard:08d}-{len(files):05d}"
                    out = fs.open_output_stream(temp)
                    now = {"records": 0, "bytes": 0}
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = packer.compress(record(key, ordinal, cols[4][i].as_py() or "", payload, size, digest, refers)) + packer.flush()
                out.write(raw)
                now["records"] += 1
                now["bytes"] += len(raw)
                if now["bytes"] >= roll:
                    close()
        commit()
        a = list(zip(*result)) if result else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.string()), pa.array(a[2], pa.int64()), pa.array(a[3], pa.int64())], names=["shard", "file", "records", "bytes"])

    return run


def _files(folder: str):
    """For ``mapInArrow``: names of manifests to the files that they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            names = []
            for manifest in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{manifest}") as f:
                    names += [x["name"] for x in json.loads(f.read())["files"]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    return run


def _reader(folder: str):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        a = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(a, kinds)], names=["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for head, block in (r for raw in members(f) for r in read_records(raw)):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"a payload in {name} does not match its digest")
                        refers = head.get("X-Refers-To-Key")
                        size = int(head["X-Payload-Length"]) if refers else len(block)
                        rows.append((None if head["X-Key"] == "None" else int(head["X-Key"]), size, digest, head["WARC-Type"], int(refers) if refers else None))
                        if len(rows) == 10_000:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    return run


#: Cells that an interval of keys is cut into at a time.
CELLS = 64


def _shards(sizes: DataFrame, shard_bytes: int) -> tuple[list[int], dict[int, tuple[int, int]], tuple[int, int]]:
    """First keys of the ranges of keys, by range; shards of keys too large for one, first and number; the same for null keys.

    A histogram of the key is cut finer wherever a cell holds too much, down to single keys; those are split by digest.
    """
    row = sizes.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("bytes").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("bytes"))).alias("keyless")).first()
    shard_bytes = shard_bytes or max(8 << 20, int(row["n"] or 0) >> 16)
    parts = lambda n: max(1, -(-int(n or 0) // shard_bytes))
    nulls = (0, parts(row["keyless"]))
    todo = [(row["a"], row["b"])] if row["a"] is not None else []
    done: list[tuple[int, int, bool]] = []  # first key, bytes, whether it is one key
    while todo:
        lows = np.array([a for a, _ in todo], np.int64)
        highs = np.array([b for _, b in todo], np.int64)
        widths = np.array([max(1, -(-(b - a + 1) // CELLS)) for a, b in todo], np.int64)

        @F.pandas_udf("long")
        def cell_of(keys, lows=lows, highs=highs, widths=widths):
            import pandas as pd

            k = keys.to_numpy(np.int64)
            at = np.maximum(np.searchsorted(lows, k, "right") - 1, 0)
            inside = (k >= lows[at]) & (k <= highs[at])
            return pd.Series(np.where(inside, at * CELLS + (k - lows[at]) // widths[at], -1))

        cells = sizes.where("key is not null").withColumn("c", cell_of("key")).where("c >= 0").groupBy("c").agg(F.sum("bytes").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"))
        todo = []
        for r in cells.orderBy("a").collect():  # a few rows for each shard's worth of bytes
            if r["n"] > shard_bytes and r["a"] < r["b"]:
                todo.append((r["a"], r["b"]))
            else:
                done.append((r["a"], r["n"], r["n"] > shard_bytes))
    firsts, crowded, held, number = [], {}, shard_bytes, nulls[1]
    for first, n, hot in sorted(done):
        if hot or held + n > shard_bytes:
            firsts.append((first, number))
            number += parts(n) if hot else 1
            held = 0
        if hot:
            crowded[first] = (firsts[-1][1], parts(n))
            held = shard_bytes  # what follows begins a shard of its own
        else:
            held += n
    return firsts, crowded, nulls


def write_warc(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = 0, roll_bytes: int = 4 << 20, level: int = 4
) -> DataFrame:
    """Write a record per row into ``folder``; returns ``shard, file, records, bytes`` of what the manifests name.

    The payload is the html in UTF-8, a null one being empty. Of equal payloads of ``REVISIT_BYTES`` or more, the record
    with the smallest key (of repeated rows the first) is a response and the others revisit it. A null key sorts before all
    others and is never referred to. A shard holds about ``shard_bytes`` of payload: by default 8 MB, or a 65,536th of all
    payloads if that is more; a key of more than that, the null one too, is spread over shards by digest. A null url is an
    empty one; control characters in urls are percent-encoded. An empty table writes no archive. Other columns are ignored.
    """
    ship(pages.sparkSession)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.sha2(payload, 256).alias("digest"), F.col(url).alias("url"), payload.alias("payload"))
    narrow = cut(rows.select("key", "digest", F.octet_length("payload").cast("long").alias("bytes")))
    # digests that repeat: pre-aggregated, so a hot payload reaches its task as one row a partition
    groups = narrow.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("key").alias("refers"), F.count("*").alias("n")).where("n > 1").select("digest", "refers")
    plan = cut(narrow.select("key", "digest").distinct().join(groups, "digest", "left"))

    firsts, crowded, nulls = _shards(narrow, shard_bytes)
    lows, numbers = np.array([a for a, _ in firsts], np.int64), np.array([n for _, n in firsts], np.int64)
    hot_keys = np.array(sorted(crowded), np.int64)
    hot_first, hot_parts = (np.array([crowded[k][i] for k in sorted(crowded)], np.int64) for i in range(2))
    shards = int(max([nulls[1] - 1, *numbers.tolist(), *(hot_first + hot_parts - 1).tolist()])) + 1

    @F.pandas_udf("long")
    def shard_of(keys, nulls_at, digests):
        import pandas as pd

        known, k = ~nulls_at.to_numpy(bool), keys.to_numpy(np.int64)
        out = numbers[np.maximum(np.searchsorted(lows, k, "right") - 1, 0)] if len(lows) else np.zeros(len(k), np.int64)
        first, parts = np.where(known, out, nulls[0]), np.where(known, 1, nulls[1])
        if len(hot_keys):
            at = np.minimum(np.searchsorted(hot_keys, k), len(hot_keys) - 1)
            hot = known & (hot_keys[at] == k)
            first, parts = np.where(hot, hot_first[at], first), np.where(hot, hot_parts[at], parts)
        split = np.flatnonzero(parts > 1)
        if len(split):
            place = np.array([int(d[:8], 16) for d in digests.to_numpy()[split]], np.int64)
            first[split] += place * parts[split] >> 32
        return pd.Series(first)

    # one shuffle moves the payloads, spread by key: each plan row travels beside the record it is for
    none = F.lit(None)
    given = plan.select("key", "digest", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("binary").alias("payload"), "refers")
    full = rows.select("key", "digest", F.lit(1).alias("kind"), "url", "payload", none.cast("long").alias("refers"))
    both = given.unionByName(full).withColumn("shard", shard_of(F.coalesce("key", F.lit(0).cast("long")), F.col("key").isNull(), "digest"))
    cols = ["shard", "key", "digest", "kind", "url", "payload", "refers"]
    placed = both.select(*cols).repartition(shards, "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "digest", "kind", "url")
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    written = cut(placed.mapInArrow(_writer(folder, roll_bytes, level), "shard long, file string, records long, bytes long"))
    total = written.agg(F.sum("records").alias("records"), F.count("*").alias("files"), F.sum("bytes").alias("bytes")).first()
    with fs.open_output_stream(f"{base}/.manifest") as f:
        f.write(json.dumps({k: total[k] or 0 for k in ("records", "files", "bytes")} | {"shards": shards}, sort_keys=True).encode())
    _commit(fs, f"{base}/.manifest", f"{base}/MANIFEST.json")
    return written


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to`` of every record of the folder; digests of payloads are checked.

    The manifests alone say which files count. A folder without archives gives no rows.
    """
    ship(spark)
    fs, base = _open(folder)
    with fs.open_input_stream(f"{base}/MANIFEST.json") as f:
        whole = json.loads(f.read())
    named = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(base)) if re.fullmatch(r"shard-\d+\.json", x.base_name))
    files = spark.createDataFrame([(n,) for n in named], "file string").repartition(max(1, len(named) // 100)).mapInArrow(_files(folder), "file string")
    return files.repartition(max(1, whole["files"]), "file").mapInArrow(_reader(folder), "key long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages as archives in the shared folder, read them back and delete them: ``key, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write_warc(pages, folder, key, url, html)
    found = cut(read_warc(spark, folder))
    discard(spark, folder)
    return found.withColumnRenamed("key", key)
