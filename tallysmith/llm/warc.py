"""WARC archives: writing segmented and deduplicated records, reading and reassembling them."""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysmith.llm.shared import measured, small_batches
from tallysmith.operators.common import checkpointed

#: Payloads from this size on are stored once.
LEAST_SHARED = 100
#: Bytes of a record's block and of a chunk in it, and records in a file at most.
SEGMENT, CHUNK, FILE_RECORDS = 32_768, 8_192, 1_000
#: Most digests of shared payloads that are broadcast, about 200 bytes each; more are joined by shuffling.
SHARED_DIGESTS = 200_000
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


# --- writing --------------------------------------------------------------------------------------------------

def planned(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", repeats: bool = False
) -> DataFrame:
    """(page_id, url, html, digest, type, id, refers, refers_to): what to write for every row of ``pages``.

    Of equal payloads of ``LEAST_SHARED`` bytes or more the one with the smallest page_id is the response, the
    others revisit it; smaller ones are all responses.  NULL html is the empty payload; a NULL page_id comes
    last.  Record ids hash page_id, url, payload and the number of the copy: with ``repeats`` rows that
    repeat all three are records 1, 2, ... and further ones revisit the first, else they are one record.

    Rows are counted by page_id, url and digest.  Payloads that occur once go straight from the table to the
    record; of the others only one row with its payload is looked up, and revisits come from the counts.  So no
    payload is shuffled, but for small ones and for digests too many to broadcast.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )
    rows = rows.withColumn("digest", F.sha2("html", 256))
    small = F.octet_length("html") < LEAST_SHARED
    counted = rows.groupBy("page_id", "url", "digest", F.when(small, F.col("html")).alias("html")).agg(F.count("*").alias("n"))
    counted = checkpointed(counted)
    order = F.struct(F.col("page_id").isNull().alias("p"), "page_id", F.col("url").isNull().alias("u"), "url")
    often = counted.filter("html IS NULL").groupBy("digest").agg(F.min(order).alias("_f"), F.sum("n").alias("_n"))
    often = often.filter("_n > 1").select("digest", F.col("_f.page_id").alias("_page"), F.col("_f.url").alias("_url"))
    often, _ = measured(often, SHARED_DIGESTS)
    leads = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("url").eqNullSafe(F.col("_url"))
    one = F.lit(1).cast("long")

    once = rows.filter(~small).join(often.select("digest"), "digest", "left_anti").withColumn("copy", one)
    first = rows.filter(~small).join(often, "digest").filter(leads).dropDuplicates(["digest"]).withColumn("copy", one)
    copies = counted.withColumn("copy", F.explode(F.sequence(one, F.col("n") if repeats else one)))
    again = copies.filter("html IS NULL").join(often, "digest").filter(~(leads & (F.col("copy") == 1)))
    name = lambda page, link, copy: F.md5(
        F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("="), link), F.lit("null")), "digest", copy.cast("string"))
    )
    own = name(F.col("page_id"), F.col("url"), F.col("copy")).alias("id")
    response = [
        "page_id", "url", F.lit("response").alias("type"), "digest", own, F.lit(None).cast("string").alias("refers"),
        F.lit(None).cast("long").alias("refers_to"), "html",
    ]
    revisit = [
        "page_id", "url", F.lit("revisit").alias("type"), "digest", own,
        name(F.col("_page"), F.col("_url"), one).alias("refers"), F.col("_page").alias("refers_to"), F.lit(None).cast("string").alias("html"),
    ]
    kinds = [once.select(*response), first.select(*response), copies.filter("html IS NOT NULL").select(*response)]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(again.select(*revisit))


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.UUID(name)}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(piece), piece) for piece in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def records(kind: str, name: str, page: int | None, url: str | None, digest: str, refers: str | None, html: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The record of a page, in continuation records where its block is longer than ``segment``."""
    target = re.sub(r"[\x00-\x20\x7f]", "", url or "") or "urn:none"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
    common += [("X-Page-Id", "" if page is None else str(page))]
    first = [("WARC-Type", kind), ("WARC-Record-ID", _urn(name)), *common]
    if kind == "revisit":
        return [_record([*first, ("WARC-Refers-To", _urn(refers)), ("WARC-Profile", PROFILE)], b"")]
    block = HTTP_HEAD + chunked((html or "").encode("utf-8"))
    first.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment:
        return [_record(first, block)]
    out, pieces = [], [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, piece in enumerate(pieces, 1):
        if n == 1:
            headers = first
        else:
            own = uuid.uuid5(uuid.UUID(name), str(n)).hex
            headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(own)), ("WARC-Segment-Origin-ID", _urn(name)), *common]
        headers = [*headers, ("WARC-Segment-Number", str(n))]
        if n == len(pieces):
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(headers, piece))
    return out


def write_archives(plan: DataFrame, path: str, segment: int = SEGMENT, per_file: int = FILE_RECORDS) -> None:
    """Write the planned records as gzipped WARC files of at most ``per_file`` records each.

    Spark's text writer commits the files, so a lost task leaves none behind.
    """

    def rendered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            page = frame["page_id"].astype("Int64")
            columns = zip(frame["type"], frame["id"], page, frame["url"], frame["digest"], frame["refers"], frame["html"])
            out, size = [], 0
            for kind, name, number, url, digest, refers, html in columns:
                number = None if number is pd.NA else int(number)
                for record in records(kind, name, number, url, digest, refers, html, segment):
                    out.append(record)
                    size += len(record)
                if size > 1 << 23:
                    yield pd.DataFrame({"value": out})
                    out, size = [], 0
            yield pd.DataFrame({"value": pd.Series(out, dtype=object)})

    small_batches(plan.sparkSession)
    columns = ["page_id", "url", "type", "digest", "id", "refers", "html"]
    bodies = plan.select(*columns).mapInPandas(rendered, "value binary").select(F.col("value").cast("string"))
    writer = bodies.write.option("lineSep", END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", per_file).text(path)


# --- reading --------------------------------------------------------------------------------------------------

def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; blocks are taken by Content-Length."""
    at = 0
    while at < len(data):
        split = data.index(END, at)
        lines = data[at:split].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        start = split + len(END)
        end = start + int(headers["content-length"])
        if end > len(data) or data[end : end + 4] != END:
            raise ValueError(f"record at byte {at} does not end where it says")
        yield headers, data[start:end]
        at = end + len(END)


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; an error if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        start = line + 2
        if body[start + size : start + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where it says")
        if size == 0:
            return b"".join(out)
        out.append(body[start : start + size])
        at = start + size + 2


def payload_of(block: bytes) -> bytes:
    """The decoded payload of an HTTP response."""
    head, _, body = block.partition(END)
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r\n", b"\n")) else body


_READ = "id string, origin string, type string, number int, total long, page_id long, url string, digest string, refers string, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under ``path``; each file is read by one task, and files are small."""
    def uid(value: str | None) -> str | None:
        return uuid.UUID(value.strip("<>").removeprefix("urn:uuid:")).hex if value else None

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows, size = [], 0
                for h, block in parse_records(gzip.decompress(content)):
                    number, total, page = h.get("warc-segment-number"), h.get("warc-segment-total-length"), h.get("x-page-id")
                    rows.append((
                        uid(h["warc-record-id"]), uid(h.get("warc-segment-origin-id")), h["warc-type"],
                        int(number) if number else None, int(total) if total else None, int(page) if page else None,
                        h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha256:"),
                        uid(h.get("warc-refers-to")), block,
                    ))
                    size += len(block)
                    if size > 1 << 23:
                        yield framed(rows)
                        rows, size = [], 0
                yield framed(rows)

    names = [c.split()[0] for c in _READ.split(", ")]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({"number": "Int32", "total": "Int64", "page_id": "Int64"})

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(parsed, _READ)


def reassembled(rows: DataFrame) -> DataFrame:
    """(id, type, page_id, url, digest, refers, payload) of every record that is not a continuation.

    Segments are grouped by their origin's id, ordered by number, and joined; the number of segments and the
    total length must be as stated, else the job fails.  Equal segments that come twice count once.  Records
    in one piece are not shuffled.
    """

    @F.pandas_udf("binary")
    def decoded(blocks: pd.Series) -> pd.Series:
        return blocks.map(payload_of)

    keep = ["id", "type", "page_id", "url", "digest", "refers"]
    single = rows.filter("number is null and type <> 'continuation'").select(*keep, "block")
    parts = rows.filter("number is not null").withColumn("_origin", F.coalesce("origin", "id"))
    head = F.max(F.when(F.col("type") != "continuation", F.struct(*keep))).alias("_head")
    piece = F.collect_set(F.struct("number", "block")).alias("_pieces")
    whole = parts.groupBy("_origin").agg(head, piece, F.max("total").alias("_total"), F.max("number").alias("_last"))
    pieces = F.array_sort("_pieces")
    # concat takes columns, not an array; hex text is joined and turned back.
    block = F.unhex(F.array_join(F.transform(pieces, lambda p: F.hex(p["block"])), ""))
    whole = whole.withColumn("block", block)
    sound = (F.size("_pieces") == F.col("_last")) & (F.octet_length("block") == F.col("_total")) & F.col("_head").isNotNull()
    fault = F.raise_error(F.concat(F.lit("segments of record "), F.col("_origin"), F.lit(" are not whole")))
    whole = whole.withColumn("block", F.when(F.coalesce(sound, F.lit(False)), F.col("block")).otherwise(fault.cast("binary")))
    every = single.unionByName(whole.select("_head.*", "block"))
    payload = F.when(F.col("type") == "response", decoded("block"))
    return every.select(*keep, payload.alias("payload"))


def digests(records: DataFrame) -> DataFrame:
    """(id, page_id, type, refers, n, d): length and SHA-256 of the payloads as read back."""
    return records.select(
        "id", "page_id", "type", "refers", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("d")
    )


def resolve(seen: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``digests``; a revisit gets those of the
    response it refers to.  A record that was read twice counts once."""
    responses = seen.filter("type = 'response'").distinct()
    own = responses.select("page_id", "n", "d", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    origin = responses.select(F.col("id").alias("refers"), F.col("page_id").alias("refers_to"), "n", "d")
    again = seen.filter("type = 'revisit'").select("id", "page_id", "refers").distinct().join(origin, "refers")
    again = again.select("page_id", "n", "d", F.lit("revisit").alias("record_type"), "refers_to")
    both = own.unionByName(again)
    return both.select(
        "page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to"
    )
