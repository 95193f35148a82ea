"""WARC archives: writing pages, and reading records back by boundary-chain verification.

Writing. Of records with equal payloads (SHA-1 and length) the one with the largest id is a `response`, the others are `revisit` records that
refer to it. Copies are combined before the shuffle, so a payload moves once per task at most. A revisit keeps the HTTP head, with the
length of the payload it stands for. Each task writes one file, through Spark's text writer with the record
terminator as separator.

Reading. The magic may also stand inside a payload, so a place where it stands is only a candidate for a record.
1. Files are read in splits, separated where a line starts with the magic; a split is a run of pieces whose lengths add up to their
   offsets: a sum within the split, plus the sums of the splits before it. No file has to fit in a task; a payload does.
2. Each piece whose head parses gives a link from its offset to that of its successor, taken from its Content-Length.
3. Pointer jumping: from the start of every file (offset 0) the reached set doubles each round, jumps are squared; only what is reached is a
   record. `stop` tells how the chain of a file ended.
4. A record that holds the magic in its payload spans several pieces; these are found by offset and joined. All other records are whole in one piece, and
   their payload digests were taken where they were read.

Everything is built from DataFrame functions; tables between rounds are written to the shared folder. All data is handled as bytes.

Defined results: null html is an empty payload; null ids are written as empty and read as null; control characters in urls are written as
%XX; equal rows (same id and payload) count one by one: one is the response, the rest revisit it. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reflexgrid.session import scratch

from .common import written
from .graph import checked

# Fixed values of the format.
MAGIC = "WARC/1."
CRLF = "\r\n"
END = CRLF + CRLF
BREAK = CRLF + MAGIC  # has no part that repeats, so a reader finds it across buffers too
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SPAN = 1 << 20
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32(hex40: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: five hex digits are four of base 32."""
    fours = [F.lpad(F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), DIGITS32, BASE32)


# ---- writing


def records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(record) strings, one per page, without the terminator."""
    plain = pages.select(F.col(id).cast("string").alias("sid"), F.col(id).alias("id"), _safe(F.coalesce(url, F.lit(""))).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = plain.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html")})
    top = F.struct("id", "url")
    best = rows.groupBy("digest", "n").agg(F.max(top).alias("top"), F.max_by("html", top).alias("html"))
    best = best.select("digest", "n", F.col("top.id").alias("to"), F.col("top.url").alias("to_url"), "html")
    copies = rows.groupBy("digest", "n", "id", "url").agg(F.count("*").alias("times"))
    pairs = copies.join(best.select(F.col("digest").alias("d"), F.col("n").alias("m"), "to", "to_url"), (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")))
    is_best = F.col("id").eqNullSafe(F.col("to")) & (F.col("url") == F.col("to_url"))
    others = pairs.withColumn("times", F.col("times") - is_best.cast("int")).where("times > 0")
    revisits = others.select("id", "url", "digest", "n", "to", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("time"))
    whole = best.select(F.concat(_head(F.lit("response"), F.col("to"), F.col("to_url"), F.col("digest"), F.col("n")), F.col("html")).alias("record"))
    return whole.unionByName(revisits.select(_head(F.lit("revisit"), F.col("id"), F.col("url"), F.col("digest"), F.col("n"), F.col("to")).alias("record")))


def _safe(url: Column) -> Column:
    out = url
    for code in [*range(32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def _head(kind: Column, id: Column, url: Column, digest: Column, n: Column, to: Column | None = None) -> Column:
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n.cast("string"), F.lit(END))
    block = F.octet_length(http) + (n if to is None else F.lit(0))
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name(id)), ("WARC-Date", F.lit("2000-01-01T00:00:00Z")), ("WARC-Target-URI", url)]
    fields.append(("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(digest))))
    if to is not None:
        fields += [("WARC-Refers-To", name(to)), ("WARC-Profile", F.lit(PROFILE))]
    fields += [("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", block.cast("string"))]
    lines = [piece for k, v in fields for piece in (F.lit(f"{k}: "), v, F.lit(CRLF))]
    return F.concat(F.lit(f"{MAGIC}1{CRLF}"), *lines, F.lit(CRLF), http)


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip") -> None:
    records(pages, id, url, html).write.option("lineSep", END).options(**{"compression": compression, "zlib.compress.level": "BEST_SPEED"}).text(path)


# ---- reading


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, bytes, value, ...): what stands between two magics at the start of a line, in the order of the split, and what it says if it is
    the head of a record. The first piece of a file still holds its magic."""
    lines = spark.read.option("lineSep", BREAK).text(path)
    raw = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    # the line end before the next magic may belong to the head or to the block
    raw = raw.withColumn("text", F.concat("value", F.lit(CRLF)))
    raw = raw.withColumn("head", F.when(F.instr("text", END) > 0, F.substring_index("text", END, 1)))
    field = lambda name: F.regexp_extract("head", rf"(?i)\r\n{name}: *([^\r\n]*)", 1)
    some = lambda c: F.when(c != "", c)
    length = F.when(field("Content-Length").rlike("^[0-9]{1,18}$"), field("Content-Length").cast("bigint"))
    out = raw.select(
        "file",
        "block",
        "seq",
        F.octet_length("value").cast("bigint").alias("bytes"),
        F.startswith("value", F.lit(MAGIC)).alias("opens"),
        (F.octet_length("head") + len(END)).cast("bigint").alias("head_bytes"),
        length.alias("length"),
        F.lower(field("WARC-Type")).alias("type"),
        some(field("WARC-Record-ID")).alias("name"),
        some(F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")).alias("stated"),
        some(field("WARC-Refers-To")).alias("to"),
        "value",
        "text",
    )
    # a block that is whole in its piece is digested here, so its text is not needed again
    whole = F.coalesce(F.col("bytes") + len(CRLF) >= F.col("head_bytes") + F.col("length"), F.lit(False))
    block = F.when(F.col("whole"), F.expr("substring(cast(text as binary), cast(head_bytes as int) + 1, cast(length as int))"))
    return out.withColumn("whole", whole).withColumns(_payload(block)).drop("text")


def _payload(block: Column) -> dict[str, Column]:
    """Of an HTTP message: the length its head states, and length and SHA-1 of what follows the head."""
    text = block.cast("string")
    head = F.substring_index(text, END, 1)
    rest = lambda: F.substring(block, F.octet_length(head) + len(END) + 1, F.octet_length(block))
    has = F.instr(text, END) > 0
    said = F.regexp_extract(head, r"(?i)\r\nContent-Length: *([0-9]{1,18})(?:\r\n|$)", 1)
    return {"said": F.when(has & (said != ""), said.cast("bigint")), "payload_bytes": F.when(has, F.octet_length(rest())).cast("bigint"), "sha1": F.when(has, F.sha1(rest()))}


LIGHT = ["file", "block", "seq", "bytes", "opens", "head_bytes", "length", "type", "name", "stated", "to", "whole", "said", "payload_bytes", "sha1"]


LIGHT = ["file", "block", "seq", "bytes", "opens", "head_bytes", "length", "type", "name", "stated", "to", "whole", "said", "payload_bytes", "sha1"]


def offsets(pieces: DataFrame) -> DataFrame:
    """The pieces with `off`, where their magic stands in the file, and, for those that may be records, `next`, where the one after it would stand."""
    took = F.col("bytes") + len(BREAK)
    before = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    splits = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy("file", "block").agg(F.sum(took).alias("total"))
    base = totals.select("file", "block", F.coalesce(F.sum("total").over(splits), F.lit(0)).alias("base"))
    start = F.col("base") + F.coalesce(F.sum(took).over(before), F.lit(0))
    placed = pieces.join(checked(base), ["file", "block"]).withColumn("start", start)
    first = F.col("start") == 0
    ends = F.col("start") + F.col("head_bytes") + F.col("length") + len(END)
    return placed.withColumns({"off": F.when(first, 0).otherwise(F.col("start") - len(MAGIC)), "next": F.when(~first | F.col("opens"), ends)}).drop("base", "start")


def reached(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of candidates (file, off, next): the (file, off) on the chain from each file's start, and (file, stop) where the chain ended."""
    jumps = written(candidates.select("file", "off", "next"), "jumps")
    seen = written(jumps.where("off = 0").select("file", "off"), "reached")
    count = seen.count()
    chain = jumps
    while True:
        landed = seen.join(jumps, ["file", "off"]).select("file", F.col("next").alias("off"))
        # targets that are no candidates end the chain
        found = landed.join(chain.select("file", "off"), ["file", "off"], "left_semi")
        seen = written(seen.union(found).distinct(), "reached")
        now = seen.count()
        if now == count:
            break
        count = now
        further = jumps.select("file", F.col("off").alias("next"), F.col("next").alias("far"))
        jumps = written(jumps.join(further, ["file", "next"]).select("file", "off", F.col("far").alias("next")), "jumps")
    ends = seen.join(chain, ["file", "off"]).groupBy("file").agg(F.max("next").alias("stop"))
    return seen, ends


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below `path`: file, off, type, name, to, stated, payload_bytes, sha1 (hex, of the bytes read), said (the payload length in the
    HTTP head), and `parts` (pieces that the record spans). Compressed archives are one split a file, and offsets those of the plain bytes."""
    fixed = "spark.sql.files.minPartitionNum"  # two scans of one archive must split it alike, also when executors come or go between them
    given = spark.conf.get(fixed, None)
    spark.conf.set(fixed, given or str(spark.sparkContext.defaultParallelism))
    try:
        pieces = written(pieces_of(spark, path).select(*LIGHT), "pieces")
        placed = written(offsets(pieces), "placed")
        candidates = placed.where("next is not null")
        kept = written(candidates.join(reached(candidates)[0], ["file", "off"]), "kept")
        broken = kept.where("not whole")
        spanning = written(_spanning(pieces_of(spark, path), placed, broken), "spanning") if broken.take(1) else None
    finally:
        spark.conf.unset(fixed) if given is None else spark.conf.set(fixed, given)
    whole = kept.where("whole").select("file", "off", "type", "name", "to", "stated", "payload_bytes", "sha1", "said", F.lit(1).alias("parts"))
    return whole if spanning is None else whole.unionByName(spanning)


def _spanning(pieces: DataFrame, placed: DataFrame, broken: DataFrame) -> DataFrame:
    """Records of several pieces: a piece belongs to the record whose range holds it. Both meet by blocks of SPAN bytes, a record in every
    block that it covers."""
    starts = broken.select("file", F.col("off").alias("start"), "next", "head_bytes", "length", "type", "name", "to", "stated")
    cells = F.sequence(F.floor(F.col("start") / SPAN), F.floor((F.col("next") - 1) / SPAN))
    inside = placed.select("file", "block", "seq", "off", F.floor(F.col("off") / SPAN).alias("cell"))
    met = inside.join(starts.select("file", "start", "next", F.explode(cells).alias("cell")), ["file", "cell"]).where("off >= start and off < next")
    met = written(met.select("file", "block", "seq", "off", "start"), "met")
    texts = pieces.select("file", "block", "seq", "value").join(checked(met), ["file", "block", "seq"])
    joined = texts.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("off", F.col("value").cast("binary").alias("value")))).alias("all"))
    data = F.array_join(F.transform("all", lambda x: F.hex(x["value"])), BREAK.encode().hex().upper())
    full = starts.join(joined.select("file", "start", F.unhex(data).alias("data"), F.size("all").alias("parts")), ["file", "start"])
    full = full.withColumn("block", F.expr("substring(data, cast(head_bytes as int) + 1, cast(length as int))"))
    return full.select("file", F.col("start").alias("off"), "type", "name", "to", "stated", "parts", *[c.alias(k) for k, c in _payload(F.col("block")).items()])


def archive(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip") -> DataFrame:
    """Write the pages as archives, read them back: (id, payload_bytes, payload_digest, record_type, refers_to, intact). Lengths and digests of
    responses are those of the bytes read; `intact` tells that they are the stated ones."""
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write(pages, path, id, url, html, compression)
    kind = pages.schema[id].dataType
    number = lambda c: F.when(F.regexp_extract(c, "^<urn:page:(.*)>$", 1) != "", F.regexp_extract(c, "^<urn:page:(.*)>$", 1)).cast(kind)
    response = F.col("type") == "response"
    own = base32(F.col("sha1"))
    return read(spark, path).select(
        number("name").alias(id),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("said")).alias("payload_bytes"),
        F.when(response, own).otherwise(F.col("stated")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("to").alias("refers_to"),
        (~response | ((own == F.col("stated")) & (F.col("payload_bytes") == F.col("said")))).alias("intact"),
    )
