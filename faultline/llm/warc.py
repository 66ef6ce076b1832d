"""WARC archives with a two-level capture index.

Pages are written as WARC records, each its own gzip member, one archive per task.
Of equal payloads only one record carries the payload; the others revisit it.

The index maps a capture key (the URL with its host reversed, and the page) to the
place of the record. The sorted keys are cut into blocks that are compressed into
index files; a sparse directory beside each file holds the first key of each block.
A lookup searches the bounds of the files, then the directory of one file, both by
bisection, reads one block by its range and searches in it. The records found are
read in the order in which they lie in the archives, neighbours at once.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import files
from faultline.llm.common import small_batches
from faultline.session import materialise, scratch_path

#: Shorter payloads are always written.
LEAST_REVISITED = 100
#: Keys of a block of the index.
BLOCK_KEYS = 2000
#: Records read at once lie within so many bytes, with gaps up to GAP.
READ_BYTES, GAP = 4_000_000, 16_384
GZIP = 31  # zlib's window bits for gzip members

CAPTURES = "capture string, file string, offset long, length long"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, url string, payload binary"
)


def reversed_host(url: Column) -> Column:
    """``host.example.com/path?query`` as ``com,example,host)/path?query``; user, port,
    scheme and fragment are left out, a null URL is empty."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    rest = F.regexp_extract(url, pattern, 2)
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(host == "", url).otherwise(
        F.concat(turned, F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))
    )


def capture_key(url: Column, page_id: Column) -> Column:
    """Reversed URL and page number, in an order that text comparison keeps."""
    number = F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat_ws(" ", F.regexp_replace(reversed_host(url), r"\s", "%20"), F.coalesce(number, F.lit("-")))


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (null for revisits), ``bytes``, ``digest``, ``refers_to``.

    The first page of a digest is found on narrow rows; only digests that occur
    twice are joined back. They are stored first: the join then has a shuffle of its
    own, of which Spark splits a digest that fills a partition.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload, 256).alias("digest"),
    )
    firsts = materialise(
        rows.where(F.col("bytes") >= LEAST_REVISITED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    joined = rows.join(firsts, "digest", "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return joined.select(
        "page_id",
        "url",
        F.when(refers.isNull(), F.col("payload")).alias("payload"),
        "bytes",
        "digest",
        refers.alias("refers_to"),
        capture_key(F.col("url"), F.col("page_id")).alias("capture"),
    )


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, which tells the payload's length."""
    header = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = header.encode() + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {'' if url is None else ' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """The columns of RECORDS from one record; the digest of a payload is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    size, kind = int(http_fields["Content-Length"]), fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")

    def page(name: str) -> int | None:
        number = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    known = payload if kind == "response" else None
    target = fields.get("WARC-Target-URI") or None
    return page("WARC-Record-ID"), size, digest, kind, page("WARC-Refers-To"), target, known


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages below ``folder``; a stored table of captures and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, name, out, at = _schema(CAPTURES), "", None, 0
        for batch in batches:
            places = []
            for capture, *page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = files.fresh_name(folder, "archive", ".warc.gz")
                    out = files.create(name)
                packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                member = packer.compress(record(*page)) + packer.flush()
                out.write(member)
                places.append((capture, name, at, len(member)))
                at += len(member)
            yield _batch(places, schema)
        if out is not None:
            out.close()

    small_batches(pages.sparkSession, 200)
    columns = ["capture", "page_id", "url", "payload", "bytes", "digest", "refers_to"]
    return materialise(with_revisits(pages).select(*columns).mapInArrow(run, CAPTURES))


INDEX = "first string, last string, file string, directory string"


def build_index(captures: DataFrame, folder: str) -> list[tuple[str, str, str, str]]:
    """Write the blocks and directories; returns (first key, last key, index file, directory)
    of each index file, in order. There is one for each partition of the sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, blocks, out, at = [], [], None, 0
        name = files.fresh_name(folder, "index", ".cdx.z")
        last = ""

        def flush() -> None:
            nonlocal at
            packed = zlib.compress("\n".join(lines).encode(), 6)
            out.write(packed)
            blocks.append(f"{lines[0].split('\t')[0]}\t{at}\t{len(packed)}")
            at += len(packed)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = files.create(name)
                # A key's captures stay in one block.
                if len(lines) >= BLOCK_KEYS and row[0] != last:
                    flush()
                last = row[0]
                lines.append("\t".join(map(str, row)))
        if out is not None:
            flush()
            out.close()
            directory = files.fresh_name(folder, "directory", ".z")
            with files.create(directory) as side:
                side.write(zlib.compress("\n".join(blocks).encode(), 6))
            first = blocks[0].split("\t")[0]
            yield _batch([(first, last, name, directory)], _schema(INDEX))

    small_batches(captures.sparkSession, 5000)
    order = ["capture", "file", "offset"]
    rows = captures.repartitionByRange("capture").sortWithinPartitions(*order)
    made = materialise(rows.mapInArrow(run, INDEX)).orderBy("first").collect()
    return [tuple(row) for row in made]


class Lookup:
    """Finds the captures of a key by bisection on the three levels."""

    def __init__(self, bounds: list[tuple[str, str, str, str]]):
        self.bounds, self.firsts = bounds, [b[0] for b in bounds]
        self.reader = files.Reader()
        self.directories = files.Recent(self._directory)
        self.blocks = files.Recent(self._block)

    def _directory(self, path: str) -> tuple[list[str], list[tuple[int, int]]]:
        rows = [r.split("\t") for r in zlib.decompress(self.reader.whole(path)).decode().split("\n")]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def _block(self, place: tuple[str, int, int]) -> tuple[list[str], list[list[str]]]:
        rows = [r.split("\t") for r in zlib.decompress(self.reader.read(*place)).decode().split("\n")]
        return [r[0] for r in rows], [r[1:] for r in rows]

    def find(self, capture: str) -> list[tuple[str, int, int]]:
        at = bisect_right(self.firsts, capture) - 1
        if at < 0 or capture > self.bounds[at][1]:
            return []
        _, _, index, directory = self.bounds[at]
        firsts, places = self.directories[directory]
        block = bisect_right(firsts, capture) - 1
        keys, rows = self.blocks[(index, *places[block])]
        low, high = bisect_left(keys, capture), bisect_right(keys, capture)
        return [(f, int(offset), int(length)) for f, offset, length in rows[low:high]]


def look_up(wanted: DataFrame, bounds: list[tuple[str, str, str, str]]) -> DataFrame:
    """Places of the captures in the column ``capture`` of ``wanted``; keys that are not in
    the index give no row. The keys are sorted first, so that a task reads a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, schema = Lookup(bounds), _schema(CAPTURES)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield _batch([(key, *place) for key in keys for place in index.find(key)], schema)

    small_batches(wanted.sparkSession, 5000)
    keys = wanted.select("capture").distinct()
    rows = keys.repartitionByRange("capture").sortWithinPartitions("capture")
    return rows.mapInArrow(run, CAPTURES)


def read_records(places: DataFrame) -> DataFrame:
    """The records at ``file``, ``offset``, ``length``, with RECORDS as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, schema = files.Reader(), _schema(RECORDS)
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in ("file", "offset", "length")), strict=True))
            at = 0
            while at < len(rows):
                file, begin, length = rows[at]
                end, upto = begin + length, at + 1
                while (
                    upto < len(rows)
                    and rows[upto][0] == file
                    and rows[upto][1] - end <= GAP
                    and rows[upto][1] + rows[upto][2] - begin <= READ_BYTES
                ):
                    end = rows[upto][1] + rows[upto][2]
                    upto += 1
                raw = reader.read(file, begin, end - begin)
                found = [
                    parse(zlib.decompress(raw[o - begin : o - begin + n], GZIP))
                    for _, o, n in rows[at:upto]
                ]
                yield _batch(found, schema)
                at = upto

    small_batches(places.sparkSession, 2000)
    rows = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(run, RECORDS)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html; other columns are ignored) as archives, index
    them, look every page up by its URL and number and read its record back.

    Returns RECORDS for each page. A null html is an empty payload; payloads under 100
    bytes are all responses. Of equal longer payloads the smallest page_id is the
    response; rows that repeat that very id are responses too, and a null id is one
    only if no row of its group has an id. A null url is an empty target.
    """
    folder = scratch_path(spark, "archives")
    captures = write_archives(pages, folder)
    bounds = build_index(captures, folder)
    wanted = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("capture"))
    return read_records(look_up(wanted, bounds))
