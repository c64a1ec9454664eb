"""WARC archives with a salvaging reader.

Records are gzip members of one or several records, or plain records. The reader checks each record as it stands: its
version line, header lines, length, end mark, and the block and payload digests whose algorithm it knows (MD5 and SHA in
hexadecimal or base 32). Where a check fails it searches for the next gzip member or the next plain version
line, goes on from there, and reports the bytes in between as a quarantined gap. Nothing after a damaged
place is lost but what the damage covers. Files are read in pieces; what is held at once is one record, or the records of
one gzip member up to ``HELD`` bytes, which wait for the member's own check.

Defined cases: null html is an empty payload; of records with equal payloads of at least 100 bytes the
smallest page_id is written as response and the others as revisits without a body; rows equal in
page_id and html are one page and are written once per row; null page_id sorts first and reads back null.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import materialise, pick, shared_dir, table

VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
#: Bytes after which a file is closed and the next begun; bytes read at once; first look at a header, which may be longer; what a member's records may hold while it isn't checked.
FILE_BYTES, PIECE, HEAD, HELD = 32 << 20, 1 << 18, 1 << 20, 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: an HTTP response, or a revisit of which the payload is held by another record; both state the payload's length."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    """The record as one gzip member."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    return MAGIC + b"\x00\x00\x00\x00\x00\x00\xff" + pack.compress(record) + pack.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def digest_fits(named: str, data: bytes) -> bool | None:
    """Whether ``data`` has the digest ``algorithm:value``; None if algorithm or form are unknown."""
    name, _, value = named.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    raw = hashlib.new(name, data).digest()
    if len(value) == 2 * len(raw):
        return value.lower() == raw.hex()
    packed = base64.b32encode(raw).decode()
    return value.upper() == packed or value.upper() == packed.rstrip("=") if len(value) in (len(packed), len(packed.rstrip("="))) else None


def payload_of(heads: dict[str, str], block: bytes) -> tuple[bytes, dict[str, str]]:
    """The payload of a record's block and the HTTP headers before it, if it holds an HTTP message."""
    if not heads.get("content-type", "").lower().startswith("application/http"):
        return block, {}
    top, _, payload = block.partition(b"\r\n\r\n")
    lines = (x.split(b":", 1) for x in top.split(b"\r\n")[1:] if b":" in x)
    return payload, {k.strip().lower().decode("latin1"): v.strip().decode("latin1") for k, v in lines}


def _sound(heads: dict[str, str], block: bytes) -> bool | None:
    """Whether the digests of a record fit; None if there is none that could be checked."""
    if "warc-truncated" in heads:
        return None
    checks = [digest_fits(heads["warc-block-digest"], block)] if "warc-block-digest" in heads else []
    if heads.get("warc-type") in ("response", "resource") and "warc-payload-digest" in heads and "warc-segment-number" not in heads:
        payload, http = payload_of(heads, block)
        if "transfer-encoding" not in http:  # writers differ on what the payload of such a message is
            checks.append(digest_fits(heads["warc-payload-digest"], payload))
    known = [x for x in checks if x is not None]
    return all(known) if known else None


def parse_head(data: bytes | bytearray) -> tuple[dict[str, str], int, int] | bool:
    """Headers, start and end of the block of the record that ``data`` begins with; False if it can't be one, True if more bytes are needed."""
    if not (data[: len(VERSION)] == VERSION or VERSION.startswith(bytes(data))):
        return False
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        return all(b":" in x for x in bytes(data).split(b"\r\n")[1:-1])  # headers so far: the rest may follow
    lines = bytes(data[:stop]).split(b"\r\n")[1:]
    if not all(b":" in x for x in lines):
        return False
    heads = {k.strip().lower().decode("latin1"): v.strip().decode("utf-8", "replace") for k, v in (x.split(b":", 1) for x in lines)}
    length = heads.get("content-length", "")
    return (heads, stop + 4, stop + 4 + int(length)) if re.fullmatch("[0-9]{1,18}", length) else False


Found = tuple[dict[str, str], bytes]


def _plain(f: BinaryIO, at: int, size: int) -> tuple[Found, int] | None:
    """The plain record at ``at`` and its end; the end mark is looked at before the block is read."""
    look, got = HEAD, True
    while got is True:
        f.seek(at)
        got = parse_head(f.read(min(look, size - at)))
        if look >= size - at:
            break
        look *= 4
    if isinstance(got, bool) or at + got[2] + 4 > size:
        return None
    f.seek(at + got[2])
    if f.read(4) != b"\r\n\r\n":
        return None
    f.seek(at + got[1])
    block = f.read(got[2] - got[1])
    return None if _sound(got[0], block) is False else ((got[0], block), at + got[2] + 4)


def _as_far(unpack: zlib._Decompress, piece: bytes) -> bytes:
    """What a broken piece of a gzip member gives before the damage."""
    out = bytearray()
    for i in range(0, len(piece), 64):
        try:
            out += unpack.decompress(piece[i : i + 64])
        except zlib.error:
            break
    return bytes(out)


def _member(f: BinaryIO, at: int, size: int) -> Iterator[tuple[Found | None, int]]:
    """(record, place) of the gzip member at ``at``: places are how far the file was read for the records, the last one is the member's end.

    A member that breaks off gives the records whole before the damage that a digest proves (or that didn't fit into HELD), and then (None, place).
    """
    unpack, plain, fed, held, waiting, reached = zlib.decompressobj(31), bytearray(), at, 0, [], at
    whole = True
    while whole and not unpack.eof and fed < size:
        f.seek(fed)
        piece, before = f.read(PIECE), unpack.copy()
        fed += len(piece)
        try:
            plain += unpack.decompress(piece)
        except zlib.error:
            plain += _as_far(before, piece)
            whole = False
        begin = 0
        while begin < len(plain):
            got = parse_head(memoryview(plain)[begin : begin + HEAD].tobytes())
            if got is True and len(plain) > begin + HEAD:
                got = parse_head(memoryview(plain)[begin:].tobytes())
            if got is True or (got and begin + got[2] + 4 > len(plain)):
                break
            block = bytes(plain[begin + got[1] : begin + got[2]]) if got else b""
            sound = _sound(got[0], block) if got and plain[begin + got[2] : begin + got[2] + 4] == b"\r\n\r\n" else False
            if sound is False:
                whole = False
                break
            begin += got[2] + 4
            waiting.append(((got[0], block), fed - len(unpack.unused_data), sound))
            held += len(block)
        del plain[:begin]
        if whole and held > HELD:
            yield from ((r, p) for r, p, _ in waiting)
            reached, waiting, held = fed - len(unpack.unused_data), [], 0
    if whole and unpack.eof and not plain:
        yield from ((r, p) for r, p, _ in waiting)
    else:
        # where a member's end is lost, its last record goes with it, and so does an only one
        near = waiting if plain and len(waiting) > 1 else waiting[:-1]
        yield from ((r, reached) for r, _, sound in near if sound)
        yield None, reached


def _next(f: BinaryIO, at: int, size: int) -> int:
    """First place from ``at`` on where a gzip member or a version line may begin; ``size`` if there is none."""
    while at < size:
        f.seek(at)
        piece = f.read(PIECE + len(VERSION))
        hits = [x for x in (piece.find(MAGIC), piece.find(VERSION)) if 0 <= x < PIECE]
        if hits:
            return at + min(hits)
        at += PIECE
    return size


def salvage(source: bytes | BinaryIO) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """('record', start, end, headers, block) and ('gap', start, end, {}, b'') in file order; together they cover every byte once.

    Of records in one gzip member, start and end say how far the file was read for each; those read with one piece share an end.
    Proven records of a member that breaks off have no bytes of their own; its bytes are a gap, in which the search goes on.
    """
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    size = f.seek(0, 2)
    at, done, gap = 0, 0, None  # done: end of what was handed out
    while at < size:
        f.seek(at)
        opening = f.read(len(VERSION))
        found: Iterator[tuple[Found | None, int]] = iter(())
        if opening.startswith(MAGIC):
            found = _member(f, at, size)
        elif opening == VERSION and (one := _plain(f, at, size)):
            found = iter([one])
        after, broken = at, True
        for record, place in found:
            broken = record is None
            if record is None:
                break
            if gap is not None:
                yield "gap", gap, at, {}, b""
                gap, done = None, at
            yield "record", done, place, *record
            after = done = place
        if broken:
            gap = done if gap is None else gap
            at = _next(f, max(at + 1, after), size)
        else:
            at = after
    if gap is not None:
        yield "gap", gap, size, {}, b""


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, first: ``first`` is the response of an equal payload for repeated ones, else null.

    Only digests held by two page ids or more are joined back; their table is written first, so that the
    planner knows its size and sends it to all tasks only if it is small.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = pick(pages, id_col, url_col, html_col).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    place = F.struct("page_id")
    repeats = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    repeats = materialise(repeats.where(~F.col("a").eqNullSafe(F.col("b"))).select("digest", "a"), "repeats")
    joined = rows.join(repeats, "digest", "left")
    revisit = F.col("a").isNotNull() & ~F.col("a.page_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("a.page_id")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of ``with_revisits`` as ``*.warc.gz`` under ``folder`` (any URI that pyarrow opens); path and n_records per file.

    A file is closed when it holds ``file_bytes`` or more. It is written under a passing name and then moved. Its name holds the attempt: where a task runs twice,
    the result (the manifest) names the files of the attempt that counts, and files of the other are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        done, out, held, size, number = [], None, 0, 0, 0

        def close() -> None:
            nonlocal out, held, size, number
            if out is not None:
                out.close()
                name = f"part-{part:06d}-{number:05d}-{attempt}.warc.gz"
                fs.move(f"{root}/{tag}", f"{root}/{name}")
                done.append((f"{folder}/{name}", held))
                out, held, size, number = None, 0, 0, number + 1

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    tag = f".writing-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{root}/{tag}", compression=None)
                packed = member(make_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"]))
                out.write(packed)
                held, size = held + 1, size + len(packed)
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "n_records"])

    return rows.mapInArrow(run, "path string, n_records long")


READ_SCHEMA = "path string, kind string, start long, stop long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _row(path: str, kind: str, start: int, stop: int, heads: dict[str, str], block: bytes, payloads: bool) -> tuple:
    if kind == "gap":
        return (path, kind, start, stop, *[None] * 7)
    number = lambda x: int(x) if x and re.fullmatch("-?[0-9]{1,19}", x) and -(1 << 63) <= int(x) < 1 << 63 else None
    payload, http = payload_of(heads, block)
    revisit = heads.get("warc-type") == "revisit"  # its payload is elsewhere; the record states digest and length
    digest = heads.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
    length = number(http.get("content-length")) if revisit else len(payload)
    return (path, kind, start, stop, number(heads.get("x-page-id")), heads.get("warc-target-uri"), heads.get("warc-type"), number(heads.get("x-refers-to-page")),
            digest, length, payload if payloads and not revisit else None)


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the files named in the column ``path``; a file is read by one task, piece by piece.

    Digest and length of a payload are those of the bytes read; without ``payloads`` the bytes themselves stay in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in READ_SCHEMA.split(", ")]

        def table_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_file(name) as f:
                    for found in salvage(f):
                        rows.append(_row(path, *found, payloads))
                        size += len(found[4]) if payloads else 200
                        if size > 8_000_000:
                            yield table_of(rows)
                            rows, size = [], 0
                if rows:
                    yield table_of(rows)

    return paths.select("path").mapInArrow(run, READ_SCHEMA)


def log_gaps(read: DataFrame, log: str) -> None:
    """Append the quarantined gaps of a reading (path, start, stop) to the Parquet table ``log``."""
    read.where("kind = 'gap'").select("path", "start", "stop").write.mode("append").parquet(log)


def round_trip(pages: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Write all pages, read all archives back."""
    written = materialise(write_archives(with_revisits(pages), folder), "manifest")
    files = written.count()
    return read_archives(written.repartition(max(1, files)), payloads)


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps go to the table ``gaps`` beside the archives; what is read is written once, so that neither reads the archives again."""
    folder = shared_dir(spark, "warc")
    got = materialise(round_trip(table(spark, sf_dir, "pages"), folder, payloads=False).drop("payload"), "warc-read")
    log_gaps(got, f"{folder}-gaps")
    return got.where("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_warc": _query}

ORACLE: dict[str, str] = {
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest, min(page_id) over (partition by h) as first from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and first <> page_id then first end as refers_to from q""",
}
