"""WARC archives: writing deduplicated records, reading them back by verified chains.

Writing: one row of text per record (header block, empty line, payload) goes
through Spark's text writer with the record terminator as line separator, so
every part file is a WARC archive and no task opens a file itself.

Reading: Spark's text reader cuts the archives at every ``WARC/1.1`` line, also
at those inside payloads, in splits of any size.  Each piece is a candidate
record at a known offset (piece lengths summed within a split, splits summed
within a file) whose header names its successor's offset.  The scan keeps no
text: it emits place, size, header and, where the payload lies in the piece, its
digest.  A candidate is a record only if it is reached from the file's start:

1. pieces that follow their predecessor's successor offset directly form runs
   (cut also where some other candidate jumps to), counted within a split;
2. pointer jumping over runs, ``log2(runs)`` rounds of one join, marks the runs
   that the file's first run reaches;
3. pieces of reached runs are the records; pieces in between belong to the
   payload of the record before.  Only these are read a second time, found by a
   fixed-size sketch of their places, and joined by offset.

Payloads are compared by SHA-1 and length.  Payloads below ``least`` bytes are
all responses; of equal ones the smallest page_id is the response.  A null
html is an empty payload; a null page_id is a record without an id and is
always a response; rows that repeat a page_id and payload are one record each,
and a repeat of the response's own id refers to that id.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gtspark.session import scratch_path

from .common import store
from .sketch import sketch

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 0
B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(col):
    """Bare upper-case base32 SHA-1 of a text's UTF-8 bytes."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(col.cast("binary")), i * 10 + 1, 10), 16, 2), 40, "0")
                      for i in range(4)])
    digits = F.array(*[F.lit(c) for c in B32])
    return F.concat(*[F.element_at(digits, F.conv(F.substring(bits, i * 5 + 1, 5), 2, 10).cast("int") + 1)
                      for i in range(32)])


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long"))
    p = p.withColumn("__sha1", F.sha1(F.col("html").cast("binary")))
    # stored, so that the plan knows its size: pages are shuffled only where many payloads repeat
    first = store(p.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
                  .groupBy("__sha1", "payload_bytes").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n"))
                  .where(F.col("__n") > 1).drop("__n"), "warc_first")
    p = p.join(first, ["__sha1", "payload_bytes"], "left").drop("__sha1")
    p = p.withColumn("payload_digest", base32_sha1(F.col("html")))
    again = F.col("__first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("__first"))
    return (p.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(again, F.col("__first"))).drop("__first"))


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one record per page under ``path``; a revisit carries no payload again but its digest and length."""
    r = records(pages, least)

    def clean(c):
        return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", " ")

    def line(name, value, when=None):
        text = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return text if when is None else F.when(when, text).otherwise("")

    revisit = F.col("record_type") == "revisit"
    own = F.md5(F.concat_ws("|", "page_id", "payload_digest", F.monotonically_increasing_id()).cast("binary"))
    uuid = F.regexp_replace(own, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    header = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean(F.col("url"))),
        line("X-Page-Id", F.col("page_id").cast("string"), F.col("page_id").isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.lit(PROFILE), revisit),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("X-Refers-To-Page-Id", F.col("refers_to").cast("string"), F.col("refers_to").isNotNull()),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"))
    r.select(F.concat(header, body).alias("value")).write.option("lineSep", END).text(path)


INDEX = ("file string, block long, ord long, key long, upto long, size long, head string, length long, whole boolean, "
         "payload_digest string")
_LENGTH = re.compile(rb"(?i)\r\ncontent-length:[ \t]*([+-]?\d+)[ \t]*\r\n")
_END, _MAGIC = END.encode(), MAGIC.encode()


def _key(file: str, block: int, place: int) -> int:
    raw = hashlib.blake2b(f"{file}|{block}|{place}".encode(), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)


def _placed(batches):
    """(batch, row, file, block, place in the block) of the pieces, in the order that they are read."""
    now, place = None, 0
    for batch in batches:
        for i, at in enumerate(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist())):
            now, place = at, (place + 1 if at == now else 0)
            yield batch, i, *at, place


def _index(batches):
    """Every piece without its text: place, size, header, and the payload's digest if it lies in the piece."""
    rows, upto, now = [], 0, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (
            pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(),
            pa.string()))], names=[x.split()[0] for x in INDEX.split(", ")])

    for batch, i, file, block, place in _placed(batches):
        if (file, block) != now:
            now, upto = (file, block), 0
        value = batch.column("value")[i].as_py() or b""
        end = value.find(_END)
        head = value[:end] if end >= 0 else None
        found = _LENGTH.search(b"\r\n" + head + b"\r\n") if head is not None else None
        length = int(found[1]) if found and abs(int(found[1])) < 1 << 62 else None
        start = end + len(_END)
        whole = length is not None and 0 <= length <= len(value) - start
        digest = base64.b32encode(hashlib.sha1(value[start:start + length]).digest()).decode() if whole else None
        rows.append((file, block, place, _key(file, block, place), upto, len(value),
                     head.decode("utf-8", "replace") if head is not None else None, length, whole, digest))
        upto += len(value) + len(_MAGIC)
        if len(rows) >= 5000:
            yield out()
            rows.clear()
    if rows:
        yield out()


def _scan(spark, path: str) -> DataFrame:
    """The text between magics, in reading order within each split."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block")))


def _taken(wanted):
    """Texts of the pieces whose key may be wanted (all without a sketch)."""
    def run(batches):
        held = []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*held), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                names=["key", "file", "block", "ord", "value"])

        for batch, i, file, block, place in _placed(batches):
            key = _key(file, block, place)
            if wanted is None or wanted.value.has([key])[0]:
                held.append((key, file, block, place, batch.column("value")[i].as_py() or b""))
            if len(held) >= 1000:
                yield out()
                held.clear()
        if held:
            yield out()
    return run


def pieces(spark, path: str) -> DataFrame:
    """The index of all pieces with ``at``, the byte offset of the magic before the piece; no text is kept."""
    raw = store(_scan(spark, path).mapInArrow(_index, INDEX), "warc_pieces")
    # a separator ends every piece but a file's last; offsets are those of the piece's text
    blocks = raw.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("__sum"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    return (raw.join(blocks, ["file", "block"])
            .withColumn("at", F.col("__base") + F.col("upto") - len(MAGIC)).drop("__base", "upto"))


def field(name: str):
    return F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head"), F.lit("\r\n")),
                                     rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)\r\n", 1), F.lit(""))


def index(spark, path: str) -> DataFrame:
    """The pieces of the archives' records: ``__open`` marks a record's first piece (-1: it holds all of it),
    ``__rec`` is the offset of the split record that a piece belongs to, -1 for none."""
    own = pieces(spark, path)
    next_at = F.col("at") + len(MAGIC) + F.octet_length("head") + len(END) + F.col("length") + len(END)
    own = store(own.withColumn("next", next_at).where(F.col("at") >= 0), "warc_candidates")

    follow = Window.partitionBy("file", "block").orderBy("at")
    slim = own.select("file", "block", "at", "next").withColumn("__prev", F.lag("next").over(follow))
    jumps = (slim.withColumn("__after", F.lead("at").over(follow))
             .where(F.col("next").isNotNull() & (F.col("__after").isNull() | (F.col("__after") != F.col("next"))))
             .select("file", F.col("next").alias("at")).distinct().withColumn("__hit", F.lit(True)))
    cut = ~F.coalesce(F.col("__prev") == F.col("at"), F.lit(False)) | F.coalesce(F.col("__hit"), F.lit(False)) | (F.col("at") == 0)
    run = F.max(F.when(F.col("__cut"), F.col("at"))).over(follow.rowsBetween(Window.unboundedPreceding, 0))
    marked = (slim.join(jumps, ["file", "at"], "left").withColumn("__cut", cut)
              .withColumn("run", run).select("file", "at", "next", "run"))
    marked = store(marked, "warc_runs")
    jump = store(marked.groupBy("file", "run").agg(F.max_by("next", "at").alias("to")), "warc_jumps")
    known = jump.select("file", "run")
    jump = jump.join(known.withColumnRenamed("run", "to"), ["file", "to"], "leftsemi").select("file", "run", "to")
    jump = store(jump, "warc_jumps")
    found = store(known.where(F.col("run") == 0), "warc_reached")
    while jump.limit(1).count():                    # 1, 2, 4, ... jumps at once
        step = found.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"))
        found = store(found.union(step).distinct(), "warc_reached")
        twice = jump.select("file", "run", F.col("to").alias("__mid")).join(
            jump.select("file", F.col("run").alias("__mid"), "to"), ["file", "__mid"])
        jump = store(twice.select("file", "run", "to"), "warc_jumps")
    real = marked.join(found, ["file", "run"], "leftsemi").select("file", "at")
    real = store(real.withColumn("__real", F.lit(True)), "warc_real")
    return store(_owners(own.join(real, ["file", "at"], "left")), "warc_index")


def _owners(own: DataFrame) -> DataFrame:
    """Give the pieces that lie inside a record's payload to the record."""
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.col("__real"), F.when(F.col("whole"), F.lit(-1).cast("long")).otherwise(F.col("at")))
    own = own.withColumn("__open", opens).withColumn("__rec", F.last("__open", True).over(upto))
    # a block's first pieces may continue a record of an earlier block
    ends = own.groupBy("file", "block").agg(F.max_by("__open", F.when(F.col("__open").isNotNull(), F.col("at")))
                                            .alias("__last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carry", F.last("__last", True).over(before)).drop("__last")
    return own.join(ends, ["file", "block"]).withColumn("__rec", F.coalesce("__rec", "__carry")).drop("__carry")


def _bodies(spark, path: str, wanted: DataFrame, thin: bool) -> DataFrame:
    """file, at, head and payload of records, from a second reading of the archives.

    ``wanted`` has the records' pieces (key, file, block, ord, at, __rec as the
    record's offset); ``thin`` sends only pieces of a fixed-size sketch on.
    """
    own = _scan(spark, path).mapInArrow(_taken(sketch(wanted.select("key")) if thin else None),
                                        "key long, file string, block long, ord long, value binary")
    texts = own.join(wanted.select("key", "file", "block", "ord", "at", "__rec"), ["key", "file", "block", "ord"])
    parts = texts.groupBy("file", "__rec").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("__parts"))
    joined = F.aggregate(F.slice("__parts", 2, 1 << 30), F.col("__parts")[0]["value"],
                         lambda a, p: F.concat(a, F.lit(MAGIC).cast("binary"), p["value"]))
    whole = parts.select("file", F.col("__rec").alias("at"), joined.alias("value"))
    whole = whole.withColumn("head", F.substring_index(F.col("value").cast("string"), END, 1))
    body = F.substring("value", F.octet_length("head") + len(END) + 1, field("Content-Length").cast("int"))
    return whole.select("file", "at", "head", body.alias("payload"))


def read(spark, path: str) -> DataFrame:
    """The archives' records: file, at, head (header lines) and payload."""
    own = index(spark, path)
    own = own.where(F.col("__rec") >= 0).unionByName(own.where(F.col("__open") == -1).withColumn("__rec", F.col("at")))
    return _bodies(spark, path, own, thin=False).withColumn("payload", F.col("payload").cast("string"))


def read_digests(spark, path: str) -> DataFrame:
    """The archives' records: file, at, head, payload_bytes and payload_digest.

    A payload in one piece was digested when it was scanned; only the pieces of
    payloads that hold the magic are read again.
    """
    own = index(spark, path)
    single = own.where(F.col("__open") == -1).select("file", "at", "head", F.col("length").alias("payload_bytes"), "payload_digest")
    split = own.where(F.col("__rec") >= 0)
    if split.isEmpty():
        return single
    again = _bodies(spark, path, split, thin=True).select(
        "file", "at", "head", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"))
    return single.unionByName(again)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages, read the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, least)
    r = read_digests(spark, path)
    revisit = field("WARC-Type") == "revisit"
    digest = F.when(revisit, F.substring(field("WARC-Payload-Digest"), 6, 32)).otherwise(F.col("payload_digest"))
    size = F.when(revisit, field("X-Payload-Length").cast("long")).otherwise(F.col("payload_bytes"))
    return r.select(field("X-Page-Id").cast("long").alias("page_id"), size.alias("payload_bytes"),
                    digest.alias("payload_digest"), field("WARC-Type").alias("record_type"),
                    field("X-Refers-To-Page-Id").cast("long").alias("refers_to"))
