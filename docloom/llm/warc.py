"""WARC archives and a two-level capture index.

write_archives() turns pages into gzip members, one WARC record each, in files that Spark's text writer commits: a record's
bytes are a row, and the row separator is one NUL byte, which gzip readers take as padding between members. Of pages with
equal payloads the one with the largest page_id is a response; the others are revisits that name it (rows that repeat that
page_id with the same payload are responses too).

build_index() runs through the archives once for the places of their members, sorts the reversed-host URL keys of all records
and packs each run of LINES of them into a compressed block (more at sizes where the directory would have over DIRECTORY
entries); the blocks stand in files like the archives' own. The sparse directory has a block's first and last key, cut to
KEY_PREFIX characters, and its range. look_up() finds the captures of many urls: bisection in the directory gives each
key's blocks, a task range-reads each block once and bisects its lines. fetch() range-reads the records found, neighbouring
ranges of an archive at once. Lookup does the same for one url, from the driver.

Executors open archives and blocks through pyarrow.fs (local or mounted folders, HDFS, S3, GCS, Azure). Memory is bounded by
a record, a block, or READ_BYTES, whatever an archive's size.

Null html is an empty payload. Null or odd urls have the key that their text gives. Repeated rows each have a record. A
url with very many captures spreads over its blocks. An empty table gives archives without records and an index without
blocks. Other columns, also ones whose names clash, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm._shared import discard, new_folder, only, small_batches, written

#: Records of equal payloads of at least so many bytes refer to each other.
LEAST_PAYLOAD = 0
#: An archive has so many records at most.
RECORDS_PER_FILE = 4000
#: Lines of the index in a compressed block, entries that the directory may have before blocks grow, and characters of a key there.
LINES, DIRECTORY, KEY_PREFIX = 1000, 1 << 17, 256
#: Bytes that a file is read by, ranges that are read at once, and the gap between ranges that is read with them.
PIECE, READ_BYTES, GAP = 1 << 16, 4 << 20, 1 << 14
#: Records are fetched by a task for each archive, but no more tasks than this, which then have several each.
MOST_TASKS = 20_000
SEPARATOR = "\0"
URL_SAFE = "!#$%&()*+,/:;=?@[]~"
DATE = "2020-01-01T00:00:00Z"
_HEX_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(c: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: ten digits are eight of base 32."""
    parts = [F.lpad(F.conv(F.substring(c, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _HEX_DIGITS, _BASE32)


def key_of(url: str | None) -> str:
    """The sort key: host labels in reverse, then `)` and the rest, lower-cased; scheme, `www.` and fragment don't count."""
    rest = (url or "").partition("://")[2] or (url or "")
    rest = rest.split("#", 1)[0]
    m = re.match(r"([^/?]*)(.*)", rest, re.S)
    host, path = m[1].lower().rpartition("@")[2], m[2] or "/"
    host, _, port = host.partition(":")
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + path.lower()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit has the HTTP headers of the full payload, without the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=URL_SAFE)}", *([] if url is None else [f"X-Target: {quote(url, safe='')}"]),
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> dict:
    """The fields of a record that record() made."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][10:-1]
    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload differs from its digest or length")
    return {
        "page_id": int(page) if page else None, "url": unquote(fields["X-Target"]) if "X-Target" in fields else None, "record_type": kind,
        "payload_bytes": full, "payload_digest": digest, "refers_to": int(fields["WARC-Refers-To"][10:-1]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def opened(uri: str) -> pa.NativeFile:
    """A file in any store that pyarrow knows, for reading at any place."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def members(file: pa.NativeFile) -> Iterator[tuple[int, int, bytes]]:
    """Place, length and content of each gzip member of a file, read piece by piece."""
    piece, at, done = b"", 0, 0  # done: of the piece
    while True:
        if done >= len(piece):
            piece, done = file.read(PIECE), 0
            if not piece:
                return
        if piece[done] == 0:
            done, at = done + 1, at + 1
            continue
        unpacker, content, begin = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if done >= len(piece):
                piece, done = file.read(PIECE), 0
                if not piece:
                    raise ValueError("an archive ends within a record")
            some = piece[done : done + 4096]
            content.append(unpacker.decompress(some))
            used = len(some) - len(unpacker.unused_data)
            done, at = done + used, at + used
        yield begin, at - begin, b"".join(content)


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """The paths of written files; their contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for each row of pages (page_id, url, html) into archives under path."""
    small_batches(pages.sparkSession)
    pages = only(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    hexed = F.sha1(F.col("html").cast("binary"))
    size = F.octet_length("html")
    # the groups meet as counts and largest ids; only digests with several pages are joined back
    several = pages.where(size >= LEAST_PAYLOAD).select("page_id", hexed.alias("sha1")).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first_id")).where("n > 1").drop("n")
    marked = pages.withColumn("sha1", hexed).join(several.hint("merge"), "sha1", "left")  # the same plan at every size
    marked = marked.withColumn("refers_to", F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    marked = marked.select("page_id", "url", "html", base32_of_hex(F.upper("sha1")).alias("digest"), "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)
            yield pa.RecordBatch.from_pydict({"value": pa.array([record(i, u, h.encode(), d, r) for i, u, h, d, r in rows], pa.binary())})

    # a binary value keeps its bytes when it is taken for a string
    packed = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, archive string, place long, length long"
RECORD_SCHEMA = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in RECORD.split(", ")])


def in_batches(rows: Iterator[dict], schema: pa.Schema, many: int = 200) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= many:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record under path: its fields, its payload's bytes (null for a revisit), its archive, and the place and length of its member there."""
    small_batches(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                with opened(archive) as file:
                    for at, length, content in members(file):
                        yield {**parsed(content), "archive": archive, "place": at, "length": length}

    return files_under(spark, path).mapInArrow(lambda batches: in_batches(rows(batches), RECORD_SCHEMA), RECORD)


def url_of(content: bytes) -> str | None:
    """The url of a record that record() made, from its head."""
    at = content.find(b"\r\nX-Target: ", 0, end := content.find(b"\r\n\r\n"))
    return unquote(content[at + 12 : content.find(b"\r\n", at + 2, end + 2)].decode()) if at >= 0 else None


LINE = "key string, archive string, place long, length long"
LINE_SCHEMA = pa.schema([("key", pa.string()), ("archive", pa.string()), ("place", pa.int64()), ("length", pa.int64())])


def build_index(spark: SparkSession, archives: str, path: str) -> None:
    """Write the index of the archives under path: blocks of sorted lines, each a gzip member."""
    small_batches(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for archive in b.column(0).to_pylist():
                with opened(archive) as file:
                    for at, length, content in members(file):
                        yield {"key": key_of(url_of(content)), "archive": archive, "place": at, "length": length}

    lines = written(files_under(spark, archives).mapInArrow(lambda batches: in_batches(rows(batches), LINE_SCHEMA, 1000), LINE), "index-lines")
    each = max(LINES, -(-lines.count() // DIRECTORY))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list[tuple]) -> pa.RecordBatch:
            text = "\n".join("\t".join(str(x).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n") for x in r) for r in rows)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            return pa.RecordBatch.from_pydict({"value": pa.array([packer.compress(text.encode()) + packer.flush()], pa.binary())})

        held: list[tuple] = []
        for b in batches:
            held += zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
            while len(held) >= each:
                yield block(held[:each])
                held = held[each:]
        if held:
            yield block(held)

    # the keys are dealt by range with the record's place as a second key, so that one much-captured url is spread too
    ordered = lines.repartitionByRange("key", "archive", "place").sortWithinPartitions("key", "archive", "place")
    blocks = ordered.mapInArrow(packed, "value binary").select(F.col("value").cast("string").alias("value"))
    blocks.write.option("lineSep", SEPARATOR).text(path)
    discard(lines)


def unescaped(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), x, flags=re.S)


def block_lines(block: bytes) -> list[tuple[str, str, int, int]]:
    """The lines of a block: key, archive, place, length."""
    out = []
    for line in block.decode().split("\n"):
        key, archive, place, length = line.split("\t")
        out.append((unescaped(key), unescaped(archive), int(place), int(length)))
    return out


class Directory:
    """The sparse directory of an index: first and last key (cut), file, place and length of each block, in the keys' order."""

    def __init__(self, spark: SparkSession, index: str) -> None:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for b in batches:
                for path in b.column(0).to_pylist():
                    with opened(path) as file:
                        for at, length, content in members(file):
                            lines = block_lines(content)
                            yield {"first": lines[0][0][:KEY_PREFIX], "last": lines[-1][0][:KEY_PREFIX], "path": path, "place": at, "length": length}

        schema = pa.schema([("first", pa.string()), ("last", pa.string()), ("path", pa.string()), ("place", pa.int64()), ("length", pa.int64())])
        found = files_under(spark, index).mapInArrow(lambda batches: in_batches(rows(batches), schema), "first string, last string, path string, place long, length long")
        blocks = sorted(tuple(r) for r in found.collect())  # DIRECTORY entries, and one more for each file, at most
        self.first, self.last, self.ranges = [b[0] for b in blocks], [b[1] for b in blocks], [b[2:] for b in blocks]

    def blocks(self, key: str) -> range:
        """The blocks that may hold the key, by bisection."""
        cut = key[:KEY_PREFIX]
        return range(bisect_left(self.last, cut), bisect_right(self.first, cut))

    def lines(self, block: int) -> list[tuple[str, str, int, int]]:
        """The lines of a block, by a range read."""
        path, place, length = self.ranges[block]
        with opened(path) as file:
            return block_lines(zlib.decompress(file.read_at(length, place), 31))


def captures(lines: list[tuple[str, str, int, int]], key: str) -> list[tuple[str, int, int]]:
    """Archive, place and length of the key's lines in a block, by bisection."""
    a = bisect_left(lines, (key,))
    z = a
    while z < len(lines) and lines[z][0] == key:
        z += 1
    return [x[1:] for x in lines[a:z]]


def look_up(urls: DataFrame, index: str) -> DataFrame:
    """archive, place and length of all captures of the urls (one column), each once."""
    spark = urls.sparkSession
    small_batches(spark)
    directory = spark.sparkContext.broadcast(Directory(spark, index))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key_of(u) for u in b.column(0).to_pylist()], pa.string())})

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(block, key) for key in b.column(0).to_pylist() for block in directory.value.blocks(key)]
            yield pa.RecordBatch.from_pydict({"block": pa.array([x[0] for x in found], pa.int32()), "key": pa.array([x[1] for x in found], pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, lines = -1, []
        for b in batches:
            out = []
            for block, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != here:
                    here, lines = block, directory.value.lines(block)
                out += captures(lines, key)
            if out:
                yield pa.RecordBatch.from_pydict({"archive": pa.array([x[0] for x in out], pa.string()), "place": pa.array([x[1] for x in out], pa.int64()), "length": pa.array([x[2] for x in out], pa.int64())})

    keys = urls.mapInArrow(keyed, "key string").distinct()
    dealt = keys.mapInArrow(in_blocks, "block int, key string").repartition("block").sortWithinPartitions("block", "key")
    return dealt.mapInArrow(read, "archive string, place long, length long")


def fetch(ranges: DataFrame, tasks: int | None = None) -> DataFrame:
    """The records in ranges of archives (archive, place, length), as read_archives() gives them; only these ranges are read, neighbouring ones at once. tasks: how many share the archives, as the ranges' own size says little."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        name, file, held, start = None, None, b"", 0
        for b in batches:
            archive, place, length = (b.column(k).to_pylist() for k in range(3))
            for k in range(b.num_rows):
                if archive[k] != name:
                    if file:
                        file.close()
                    name, file, held, start = archive[k], opened(archive[k]), b"", 0
                end = place[k] + length[k]
                if end > start + len(held) or place[k] < start:
                    z = k + 1
                    while z < b.num_rows and archive[z] == name and place[z] - end <= GAP and place[z] + length[z] - place[k] <= READ_BYTES:
                        end, z = place[z] + length[z], z + 1
                    held, start = file.read_at(end - place[k], place[k]), place[k]
                member = held[place[k] - start : place[k] - start + length[k]]
                yield {**parsed(zlib.decompress(member, 31)), "archive": name, "place": place[k], "length": length[k]}
        if file:
            file.close()

    dealt = ranges.repartition(*([tasks] if tasks else []), "archive").sortWithinPartitions("archive", "place")  # an archive has RECORDS_PER_FILE records at most
    return dealt.mapInArrow(lambda batches: in_batches(rows(batches), RECORD_SCHEMA), RECORD)


class Lookup:
    """Finds captures by url from the driver: bisection in the sparse directory, range reads of the blocks that may hold the key, bisection there, range reads of records."""

    def __init__(self, spark: SparkSession, index: str) -> None:
        self.directory = Directory(spark, index)

    def captures(self, url: str) -> list[tuple[str, int, int]]:
        key = key_of(url)
        return sorted(x for block in self.directory.blocks(key) for x in captures(self.directory.lines(block), key))

    def read(self, archive: str, place: int, length: int) -> dict:
        """The record in a range of an archive; only that range is read."""
        with opened(archive) as file:
            return parsed(zlib.decompress(file.read_at(length, place), 31))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write archives and index of pages into the shared folder, then look every page's url up in the index and read the records of its captures by their ranges."""
    spark = pages.sparkSession
    archives, index = new_folder(spark, "warc"), new_folder(spark, "warc-index")
    write_archives(pages, archives)
    build_index(spark, archives, index)
    many = files_under(spark, archives).count()
    return fetch(look_up(only(pages, "url"), index), min(max(1, many), MOST_TASKS))
