"""WARC archives: a deduplicating writer and a reader that salvages what is whole.

write() makes one or more archives in each task, a gzip member for each record, through the file system that the folder's
URI names. Archives of failed attempts stay unnamed: only those in the returned manifest count. Pages with equal
payloads become one response, that of the largest id, and revisits of it.

read() goes through an archive record by record. A record counts if its member's checksum, its length, its end and its
digests hold. Where one does not, the reader looks for the next version line, in the member as it unpacks and then in the
file, or the next gzip member behind it that begins a record which does, and logs the bytes between as a quarantined gap.
A member may hold any number of records; memory holds one record and a window of the file.

Defined results: a null html is an empty payload, and empty payloads are equal to each other; a null url gives no
target; pages with a null id come before all others in rank, have no id to be referred to by, and stay responses where
the whole group has none; rows that repeat the largest id of their group are responses, all of them. A payload over
RECORD_BYTES is an error. Columns other than the three named are left out, whatever their names. An empty table gives no
archive and no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh_path, map_rows, materialize, utf8

#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
WINDOW = 1 << 20
#: Bytes of one record's block: write() refuses more, as a cell of a table couldn't hold them, and read() takes a length beyond
#: it for damage. A member may hold any number of records.
RECORD_BYTES = 1 << 30
#: Unpacked bytes of a member that are kept while its checksum is awaited; a longer member is unpacked twice.
HELD = 8 << 20
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS, LENGTH = re.compile(rb"WARC/1\.[01]\r\n"), re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", re.I)
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
ID = "<urn:x-page:{}>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# Writing


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """A record, not yet compressed."""
    if len(block) > RECORD_BYTES:
        raise ValueError(f"a record of {len(block)} bytes; at most {RECORD_BYTES} can be read back")
    head = {"WARC-Type": kind, **fields, "WARC-Date": DATE, "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit if it refers to one. A revisit keeps the head, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Record-ID": ID.format("null" if page_id is None else page_id), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": ID.format(refers_to)}, http)


def write(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Writes archives into the folder (None: a new one in the shared folder). Returns the manifest: (path, records, bytes)."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), utf8(html_col).alias("payload")).withColumn("sha", F.sha1("payload")).withColumn("key", F.sha2("payload", 256))
    # SHA-256 decides which payloads are equal, as others with one SHA-1 are known; SHA-1 is what the format's field holds.
    # Unique payloads, nearly all, leave the join's right side.
    heads = rows.groupBy("key").agg(F.max("id").alias("head"), F.count("*").alias("n")).filter("n > 1").select("key", "head")
    told = rows.join(heads, "key", "left").select("id", "url", "payload", "sha", F.when(~F.col("id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        done, out, name, written, n = [], None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, written))
                out = None

        for b in batches:
            for page_id, url, payload, sha, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is not None and written >= archive_bytes:
                    close()
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, written, n = store.open_output_stream(f"{at}/{name}", compression=None), 0, 0
                    info = gzip.compress(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), level, mtime=0)
                    out.write(info)
                    written += len(info)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = gzip.compress(page_record(page_id, url, payload, digest, refers_to), level, mtime=0)
                out.write(data)
                written, n = written + len(data), n + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return materialize(map_rows(told, work, "path string, records long, bytes long"), "manifest")


# Reading


class Damage(ValueError):
    """What a check found."""


class Window:
    """A file's bytes by place, a stretch of them in memory."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def at(self, begin: int, n: int) -> bytes:
        end = min(self.size, begin + n)
        if begin < self.base or end > self.base + len(self.data):
            self.file.seek(begin)
            self.base, self.data = begin, self.file.read(max(end - begin, min(WINDOW, self.size - begin)))
        return self.data[begin - self.base : max(begin, end) - self.base]


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Fields (in lower case), block and end of the record that begins here; Damage if a check fails."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise Damage("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Damage("the head has no end")
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damage("a head line without a colon")
        fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length) or not fields.get("warc-type"):
        raise Damage("no length or type")
    begin = head + 4
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("the block does not end where its length says")
    block = data[begin:end]
    if (d := fields.get("warc-block-digest", "")).startswith("sha1:") and d[5:] != base32_sha1(block):
        raise Damage("the block's digest differs")
    if fields["warc-type"] == "response" and (d := fields.get("warc-payload-digest", "")).startswith("sha1:") and d[5:] != base32_sha1(block.partition(b"\r\n\r\n")[2]):
        raise Damage("the payload's digest differs")
    return fields, block, end + 4


class _Member:
    """The gzip member that begins at a place: what it unpacks to, as far as it can be unpacked, and whether it is whole."""

    def __init__(self, window: Window, at: int):
        self.window, self.at, self.end, self.error, self.kept = window, at, at, "", []
        held = 0
        for part in self.unpack():
            held += len(part)
            if self.kept is not None:
                self.kept.append(part)
            if held > HELD:
                self.kept = None

    def unpack(self) -> Iterator[bytes]:
        unpack, p, step = zlib.decompressobj(31), self.at, 1 << 14
        self.error = ""
        while not unpack.eof:
            chunk = self.window.at(p, step)
            if not chunk:
                self.error = "the member has no end"
                return
            try:
                part = unpack.decompress(chunk, WINDOW)
                while part or unpack.unconsumed_tail:
                    yield part
                    part = unpack.decompress(unpack.unconsumed_tail, WINDOW) if unpack.unconsumed_tail else b""
            except zlib.error as e:
                self.error = f"the member is broken: {e}"
                return
            p += len(chunk)
            step = min(step * 2, WINDOW)
        self.end = p - len(unpack.unused_data)

    def chunks(self) -> Iterator[bytes]:
        return iter(self.kept) if self.kept is not None else self.unpack()


class _Feed:
    """A stretch of a stream of bytes, from ``at`` on."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.data, self.at, self.done = chunks, b"", 0, False

    def grow(self, n: int) -> int:
        """How many bytes there are, of n that are wanted."""
        parts, have = [], len(self.data) - self.at
        while have < n and not self.done:
            chunk = next(self.chunks, None)
            if chunk is None:
                self.done = True
            else:
                parts.append(chunk)
                have += len(chunk)
        if parts:
            self.data, self.at = b"".join([self.data[self.at :], *parts]), 0
        return have


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes] | tuple[None, str]]:
    """The records (fields, block) in a stream, and (None, reason) for each stretch between them that is none."""
    feed = _Feed(chunks)
    while feed.grow(1):
        try:
            step = 1 << 12
            while (have := feed.grow(step)) >= step and feed.data.find(b"\r\n\r\n", feed.at) < 0 and step < WINDOW:
                step *= 4
            head = feed.data.find(b"\r\n\r\n", feed.at)
            found = LENGTH.search(feed.data, feed.at, head + 2) if head >= 0 else None
            if not found or not VERSIONS.match(feed.data, feed.at) or len(found[1]) > 18 or int(found[1]) > RECORD_BYTES:
                raise Damage("no head, or no length in it")
            total = head + 8 + int(found[1]) - feed.at
            if feed.grow(total) < total:
                raise Damage("the record has no end")
            fields, block, end = parse(feed.data, feed.at)
        except Damage as e:
            yield None, str(e)
            feed.at += 1
            while not (m := VERSIONS.search(feed.data, feed.at)):
                feed.at = max(feed.at, len(feed.data) - 9)
                if feed.grow(WINDOW) <= 9 or feed.done and not VERSIONS.search(feed.data, feed.at):
                    return
            feed.at = m.start()
            continue
        feed.at = end
        yield fields, block


def _plain(window: Window, at: int) -> tuple[bytes, int]:
    """The bytes of an uncompressed record here, by its length."""
    n = 1 << 14
    while True:
        data = window.at(at, n)
        head = data.find(b"\r\n\r\n")
        if head >= 0 or len(data) < n or n > WINDOW:
            break
        n *= 4
    found = LENGTH.search(data, 0, max(head, 0) + 2)
    if not found or len(found[1]) > 18 or int(found[1]) > RECORD_BYTES:
        raise Damage("no head, or no length in it")
    end = head + 4 + int(found[1]) + 4
    return window.at(at, end), at + end


def salvage(file, size: int) -> Iterator[tuple[str, int, int, object]]:
    """('record', begin, end, (fields, block)) and ('gap', begin, end, reason), in the order of the file.

    A record's place is that of its gzip member. Of a member that is broken, the records whose blocks have their digests
    count, and are placed at its begin, where the gap follows; what is lost inside a whole member is told behind it, as a
    gap without bytes of the file.
    """
    window, at, lost, reason = Window(file, size), 0, None, ""
    while at < size:
        error, end, good = "", at, 0
        if window.at(at, 2) == b"\x1f\x8b":
            member = _Member(window, at)
            error, end = member.error, member.end
            inside = []
            for x in _records(member.chunks()):
                if x[0] is None:
                    inside.append(x[1])
                elif not error or x[0].get("warc-block-digest", "").startswith("sha1:"):
                    if lost is not None:
                        yield "gap", lost, at, reason
                        lost = None
                    yield "record", at, at if error else end, x
                    good += 1
            if not error and good and inside:
                yield "gap", end, end, f"{len(inside)} stretches in the member: {inside[0]}"
            if not error and not good:  # nothing else can begin inside a whole member
                if lost is None:
                    lost, reason = at, inside[0] if inside else "the member is empty"
                at = end
                continue
        else:
            try:
                data, end = _plain(window, at)
                fields, block, _ = parse(data)
                if lost is not None:
                    yield "gap", lost, at, reason
                    lost = None
                yield "record", at, end, (fields, block)
            except Damage as e:
                error = str(e)
        if not error:
            at = end
            continue
        if lost is None:
            lost, reason = at, error
        p, at = at + 1, size
        while p < size:  # the next place where a record could begin
            stretch = window.at(p, WINDOW)
            if m := START.search(stretch):
                at = p + m.start()
                break
            p += max(1, len(stretch) - 9) if p + len(stretch) < size else len(stretch)
    if lost is not None:
        yield "gap", lost, size, reason


SCHEMA = "path string, begin long, end long, kind string, id string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary, reason string"


def read(manifest: DataFrame, *, payload: bool = True) -> DataFrame:
    """Rows of SCHEMA from archives named in column path: each record, and each gap with its reason (kind 'gap').

    payload: whether the payload comes along; a revisit has none.
    """
    paths = manifest.select("path", (F.col("records") if "records" in manifest.columns else F.lit(None)).cast("long").alias("records"))
    # One archive a task: the manifest's own rows are few and lie together.
    paths = paths.repartition(max(1, min(paths.count(), 100_000)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        fields = ["path", "begin", "end", "kind", "id", "refers_to", "url", "payload_digest", "payload_bytes", "payload", "reason"]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], fields)
            rows, held = [], 0
            return out

        for b in batches:
            for path, due in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                there, gaps = 0, 0
                with store.open_input_file(at) as file:
                    for what, begin, end, x in salvage(file, file.size()):
                        if what == "gap":
                            gaps += 1
                            rows.append((path, begin, end, "gap", None, None, None, None, None, None, x))
                        else:
                            f, block = x
                            there += f["warc-type"] != "warcinfo"
                            head, _, body = block.partition(b"\r\n\r\n") if f.get("content-type", "").startswith("application/http") else (b"", b"", block)
                            length = len(body)
                            if f["warc-type"] == "revisit" and (m := re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})(?!\d)", head, re.I)):
                                length = int(m[1])
                            digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                            kept = body if payload and f["warc-type"] != "revisit" else None
                            rows.append((path, begin, end, f["warc-type"], f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), digest, length, kept, None))
                            held += len(kept or b"")
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield flush()
                    if due is not None and due != there and not gaps:
                        rows.append((path, file.size(), file.size(), "gap", None, None, None, None, None, None, f"{there} records where the manifest has {due}"))
        yield flush()

    return map_rows(paths, work, SCHEMA)


def page_id(column: str) -> F.Column:
    """The page's id in a record's id; null where there is none."""
    return F.expr(f"try_cast(regexp_extract({column}, '<urn:x-page:(-?[0-9]+)>', 1) as bigint)")
