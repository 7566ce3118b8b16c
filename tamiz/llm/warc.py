"""Web archives of pages: WARC/1.1 records in Zstandard files with a dictionary.

A file is a series of Zstandard frames, as ``.warc.zst`` readers expect them:

* a skippable frame ``5D 2A 4D 18`` with the dictionary (itself compressed),
* a ``warcinfo`` record, then the records, each compressed on its own with the
  dictionary,
* after each of these an empty skippable frame, ``50 2A 4D 18 00 00 00 00``,
  which decoders pass over.

Those eight bytes are ASCII, and no frame is written that holds them. So Spark's
text source takes them as its line separator: its committer writes the files (a
lost task leaves nothing half done), and its reader splits large files between
tasks at any record. Neither side needs more memory than a record.

The dictionary is trained on a sample of the records, about ``SAMPLE`` of up to
``SAMPLE_BYTES`` bytes, spread by a hash of their content. It changes the size
of files only.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tamiz.session import materialize, new_folder

DICTIONARY = b"\x5d\x2a\x4d\x18"
SKIPPED = b"\x50\x2a\x4d\x18\0\0\0\0"

SAMPLE = 1000
SAMPLE_BYTES = 32 << 10
DICTIONARY_BYTES = 64 << 10
#: Payloads of fewer bytes are written each time they occur.
LEAST_REVISIT = 1000
#: Groups of equal payloads that are broadcast, at most (about 200 bytes each).
BROADCAST_GROUPS = 50_000
#: A batch of frames on its way to the writer.
BATCH_BYTES = 4 << 20

SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Records and frames


def _field(value: str) -> str:
    """A header's value: control characters and outer blanks, which neither
    URIs nor header lines have, are percent-encoded."""
    inner = value.strip(" ")
    at = value.find(inner) if inner else len(value)
    value = "%20" * at + inner + "%20" * (len(value) - at - len(inner))
    return "".join(quote(c) if c < " " or "\x7f" <= c <= "\x9f" or c in "  " else c for c in value)


def make_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def page_record(
    kind: str, record_id: str, page, url: str | None, payload: bytes, sha1: bytes, date: str, refers: tuple | None = None
) -> bytes:
    """Record of a page; ``refers`` is (record id, page id) of the response
    that a revisit stands for. A revisit has the head of the HTTP message only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _field(url)))
    if page is not None:
        fields.append(("Page-ID", quote(str(page), safe="")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()))
    if refers is not None:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<urn:uuid:{refers[0]}>")]
        if refers[1] is not None:
            fields.append(("Page-Refers-To", quote(str(refers[1]), safe="")))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return make_record(kind, fields, head if refers is not None else head + payload)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and block; ValueError if the record
    is not as long as it says."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip(" ") for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    return fields, rest[:size]


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary of at most ``size`` bytes; empty if the records are too few
    or too short to learn from."""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, records)) // 8), records, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class Writer:
    """Frames of one file."""

    def __init__(self, dictionary: bytes, level: int = 3):
        self.dictionary = dictionary
        options = {"level": level, "write_checksum": True}
        if dictionary:
            options["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
            options["dict_data"].precompute_compress(level)
        self.compressor = zstandard.ZstdCompressor(**options)

    def head(self) -> bytes | None:
        """The leading frame; None without a dictionary."""
        if not self.dictionary:
            return None
        for level in (19, 9, 3, 1):
            body = zstandard.ZstdCompressor(level=level).compress(self.dictionary)
            if SKIPPED not in body:
                break
        return DICTIONARY + struct.pack("<I", len(body)) + body

    def frame(self, record: bytes) -> bytes:
        """A record as a frame without the separator. Where it would occur, as
        in a record that has these bytes itself, a block ends within them."""
        made, cuts = self.compressor.compress(record), [0]
        for shift in range(1, len(SKIPPED)):
            if SKIPPED not in made:
                return made
            cuts, at = [0], record.find(SKIPPED)
            while at >= 0:
                cuts.append(at + shift)
                at = record.find(SKIPPED, at + 1)
            if len(cuts) == 1:
                cuts += range(shift, len(record), 4096)
            stream = self.compressor.compressobj(size=len(record))
            parts = []
            for a, b in zip(cuts, [*cuts[1:], len(record)]):
                parts += [stream.compress(record[a:b]), stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)]
            made = b"".join([*parts, stream.flush()])
        if SKIPPED in made:
            raise ValueError("a record that can't be told from the separator")
        return made


class Reader:
    """Records of frames; a frame names its dictionary by an id."""

    def __init__(self, heads: list[bytes]):
        self.plain = zstandard.ZstdDecompressor()
        found = [zstandard.ZstdCompressionDict(dictionary_of(head)) for head in heads]
        self.by_id = {d.dict_id(): zstandard.ZstdDecompressor(dict_data=d) for d in found}

    def record(self, frame: bytes) -> bytes:
        try:
            own = zstandard.get_frame_parameters(frame)
            return self.by_id[own.dict_id].decompress(frame) if own.dict_id else self.plain.decompress(frame)
        except (zstandard.ZstdError, KeyError) as cause:
            raise ValueError("damaged frame of an archive, or its dictionary is missing") from cause


def dictionary_of(head: bytes) -> bytes:
    """The dictionary in a leading skippable frame."""
    if head[:4] != DICTIONARY or struct.unpack_from("<I", head, 4)[0] != len(head) - 8:
        raise ValueError("not a frame of a dictionary")
    body = head[8:]
    return zstandard.ZstdDecompressor().decompress(body) if body[:4] == zstandard.FRAME_HEADER else body


# Pages that repeat a payload


def with_roles(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(page, url, payload, same, role, named, refers) of every page. Of pages
    with equal payloads of ``least`` bytes or more, one of the largest id is a
    ``response``, the others are its ``revisit`` and have that id as ``refers``;
    all others are responses. ``named`` tells the responses that are revisited.

    Groups are found by SHA-256, of which one row per page meets, not the
    payload. Pages are not shuffled, unless more than ``BROADCAST_GROUPS``
    payloads are repeated: then they meet their group by its hash, but for
    groups of more than a ten-thousandth of all pages, which are broadcast.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page).alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    long = F.octet_length("payload") >= least
    # A null id is smaller than any other.
    per_page = rows.where(long).groupBy("same", "page").agg(F.count("*").alias("n"))
    groups = per_page.groupBy("same").agg(F.max(F.struct("page", "n")).alias("top"), F.sum("n").alias("n")).where("n > 1")
    groups = materialize(groups.select("same", F.col("top.page").alias("refers"), F.col("top.n").alias("n_top"), "n"), "copies")
    n_groups, n_ties = groups.select(F.count("*"), F.count_if(F.col("n_top") > 1)).first()
    found = groups.select(F.col("same").alias("key"), "refers", "n_top")
    # Keys that no group has are all different, so that none is frequent.
    own = F.monotonically_increasing_id().cast("string").cast("binary")
    rows = rows.withColumn("key", F.when(long, F.col("same")).otherwise(own))
    if n_groups <= BROADCAST_GROUPS:
        rows = rows.join(F.broadcast(found), "key", "left")
    else:
        share = pages.count() / min(10_000, BROADCAST_GROUPS)
        hot = F.broadcast(found.join(groups.where(F.col("n") > share).select(F.col("same").alias("key")), "key", "left_semi"))
        rest = found.join(groups.where(F.col("n") <= share).select(F.col("same").alias("key")), "key", "left_semi")
        rest = rest.withColumnsRenamed({"refers": "refers_2", "n_top": "n_top_2"})
        rows = rows.join(hot, "key", "left").withColumn("key", F.when(F.col("n_top").isNull(), F.col("key")).otherwise(own))
        rows = rows.join(rest, "key", "left").withColumn("refers", F.when(F.col("n_top").isNull(), F.col("refers_2")).otherwise(F.col("refers")))
        rows = rows.withColumn("n_top", F.coalesce("n_top", "n_top_2"))
    top = F.col("page").eqNullSafe(F.col("refers"))
    role = (
        F.when(F.col("n_top").isNull() | (top & (F.col("n_top") == 1)), "response").when(top, "tie").otherwise("revisit")
    )
    rows = rows.select("page", "url", "payload", "same", role.alias("role"), F.col("n_top").isNotNull().alias("named"), "refers")
    if not n_ties:
        return rows
    # Several rows of a group have its largest id: the first of them answers.
    ties = materialize(rows.where("role = 'tie'"), "ties").withColumn("at", F.monotonically_increasing_id())
    first = ties.groupBy("same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    ties = ties.join(first, "at", "left").withColumn("role", F.when(F.col("first"), "response").otherwise("revisit"))
    return rows.where("role <> 'tie'").unionByName(ties.select(rows.columns))


def _sample(pages: DataFrame, page: str, url: str, html: str, date: str) -> list[bytes]:
    """Records of about ``SAMPLE`` different pages, chosen by their content."""
    payload = F.col(html).cast("binary")
    rows = pages.select(F.col(page).cast("string").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    slot = F.pmod(F.xxhash64("payload"), F.lit(1 << 31))
    rows = rows.where(F.octet_length("payload").between(1, SAMPLE_BYTES) & (slot < (1 << 31) * SAMPLE // max(1, pages.count())))
    rows = rows.groupBy("payload").agg(F.max(F.struct("page", "url")).alias("of")).orderBy(F.xxhash64("payload")).limit(SAMPLE)
    out = []
    for r in rows.collect():
        sha1 = hashlib.sha1(r["payload"]).digest()
        out.append(page_record("response", str(uuid.UUID(bytes=sha1[:16])), *r["of"], bytes(r["payload"]), sha1, date))
    return out


# Archives


def write_archives(
    pages: DataFrame,
    folder: str,
    page: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = LEAST_REVISIT,
    date: datetime.datetime | None = None,
    dictionary: bytes | None = None,
) -> None:
    """Write a record of every page to archive files in ``folder``, one file
    per task, in the order of the table. The payload is ``html`` as UTF-8 bytes
    (null: empty); ``dictionary`` is trained on a sample if not given.

    A null url or id has no header line, and control characters of urls are
    percent-encoded. Rows that repeat an id are pages of their own; equal ones
    in id and payload are one response and its revisits. No pages give files
    without records. Other columns are ignored, whatever their names.
    """
    date = (date or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    dictionary = train_dictionary(_sample(pages, page, url, html, date)) if dictionary is None else dictionary
    space = uuid.uuid4()
    rows = with_roles(pages, page, url, html, least)

    def frames(batches):
        from pyspark import TaskContext

        writer, task, n = Writer(dictionary), TaskContext.get().partitionId(), 0
        out, size = [], 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("page", "url", "same", "role", "named", "refers")]
            for i, (key, address, same, role, named, refers) in enumerate(zip(*columns)):
                if not n:
                    info = make_record("warcinfo", [
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(space, f'{task}')}>"), ("WARC-Date", date),
                        ("Content-Type", "application/warc-fields"),
                    ], b"software: tamiz\r\nformat: WARC File Format 1.1\r\n")
                    out += [x for x in (writer.head(), writer.frame(info)) if x]
                n += 1
                payload = b.column("payload")[i].as_py()
                sha1 = hashlib.sha1(payload).digest()
                answer = (str(uuid.uuid5(space, f"{refers}:{same.hex()}")), refers) if named else None
                revisit = role == "revisit"
                own = answer[0] if named and not revisit else str(uuid.uuid5(space, f"{task}/{n}"))
                record = page_record(role, own, key, address, payload, sha1, date, answer if revisit else None)
                out.append(writer.frame(record))
                size += len(out[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    made = rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    made.write.option("lineSep", SKIPPED.decode("ascii")).text(folder)


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(frame) of all files, dictionaries included."""
    lines = spark.read.option("lineSep", SKIPPED.decode("ascii")).text(folder)
    return lines.select(F.col("value").cast("binary").alias("frame"))


def read_archives(spark: SparkSession, folder: str, page_type: str = "long", payloads: bool = True) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``payload_bytes`` and
    ``payload_digest`` (lower-case hex SHA-1) of the full payload,
    ``record_type``, ``refers_to`` (page id, of revisits), ``record_id``,
    ``refers_record`` and, if ``payloads``, ``payload`` (null for revisits).

    Every response is checked against its digest and lengths; a damaged record
    fails the read. Of the dictionaries, one per time of writing, each comes to
    the driver once.
    """
    frames = read_frames(spark, folder)
    is_head = F.substring("frame", 1, 4) == F.lit(DICTIONARY)
    heads = [bytes(r[0]) for r in frames.where(is_head).distinct().collect()]
    fields = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers", "record_id", "refers_record"]
    schema = T.StructType(
        [T.StructField(c, T.LongType() if c == "payload_bytes" else T.StringType()) for c in fields]
        + [T.StructField("payload", T.BinaryType())] * payloads
    )

    def parsed(batches):
        reader = Reader(heads)
        for b in batches:
            rows = []
            for frame in b.column(0):
                own, block = parse_record(reader.record(frame.as_py()))
                if own["warc-type"] not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                lengths = [line.split(b":")[1] for line in head.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
                digest = base64.b32decode(own["warc-payload-digest"].removeprefix("sha1:"))
                whole = own["warc-type"] == "response"
                if whole and (int(lengths[0]) != len(payload) or hashlib.sha1(payload).digest() != digest):
                    raise ValueError(f"record {own['warc-record-id']} does not hold the payload it names")
                ids = [unquote(own[k]) if k in own else None for k in ("page-id", "page-refers-to")]
                row = [ids[0], own.get("warc-target-uri"), int(lengths[0]), digest.hex(), own["warc-type"], ids[1]]
                rows.append([*row, own["warc-record-id"], own.get("warc-refers-to")] + [payload if whole else None] * payloads)
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.string()] * 2 + [pa.int64()] + [pa.string()] * 5 + [pa.binary()])],
                schema.names,
            )

    found = frames.where(~is_head).mapInArrow(parsed, schema)
    ids = {"page": F.col("page").cast(page_type).alias("page_id"), "refers": F.col("refers").cast(page_type).alias("refers_to")}
    return found.select(*(ids.get(c, F.col(c)) for c in schema.names))


def read_pages(spark: SparkSession, folder: str, page_type: str = "long") -> DataFrame:
    """(``page_id``, ``url``, ``html``) of every page; revisits get the payload
    of the record that they refer to."""
    records = read_archives(spark, folder, page_type)
    html = F.col("payload").cast("string").alias("html")
    whole = records.where("record_type = 'response'").select("page_id", "url", html)
    again = records.where("record_type = 'revisit'").select("page_id", "url", F.col("refers_record").alias("record_id"))
    answers = records.where("record_type = 'response'").select("record_id", "payload")
    return whole.unionByName(again.join(answers, "record_id").select("page_id", "url", html))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to archives in a new folder of the shared directory and read
    what they tell of each page."""
    spark, folder = pages.sparkSession, new_folder(pages.sparkSession, "archives")
    write_archives(pages, folder, **options)
    kind = pages.schema[options.get("page", "page_id")].dataType.simpleString()
    return read_archives(spark, folder, kind, payloads=False)
