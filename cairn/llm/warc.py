"""Fixity of WARC archives by Merkle trees.

An archive is a table of records: file, offset, length and the record's bytes (header lines, a blank line, the
body). Leaves are the SHA-256 digests of a file's records with their offsets and lengths, in order of offset;
every node above covers ``fanout`` neighbours. The roots of two replicas are compared file by file, and only below
nodes that differ are children compared, down to the damaged records. Records are hashed once, where they are
read; only digests are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.jobs import cut

FANOUT = 16
RECORDS_A_FILE = 2_000


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record of a page; the date and the ids are those of the row, so replicas agree."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "%0A"),
        F.lit("\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:"),
        F.sha2(body, 256),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archive(pages: DataFrame, records_a_file: int = RECORDS_A_FILE) -> DataFrame:
    """(file, page_id, payload): pages as records, dealt to files by a hash of their id, url and text.

    A null text or url is empty, a null id an empty one. Equal rows lie in one file. Other columns are not read.
    """
    files = max(1, -(-pages.count() // records_a_file))
    return pages.select(
        F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url", F.md5("html"))), 1, 8), 16, 10).cast("long"), F.lit(files)).alias("file"),
        F.col("page_id").cast("long").alias("page_id"),
        record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("payload"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """(file, place, page_id, start, length, digest): the records of each file by page and digest, laid end to end.

    Equal records of a file are one leaf, which starts at the first of them and covers all.
    """
    found = records.select("file", "page_id", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("sum"))
    found = found.groupBy("file", "page_id", "length", "sum").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("file").orderBy("page_id", "sum")
    before = F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = cut(found).select(
        "file", "page_id", "length", "sum", "copies",
        (F.row_number().over(order) - 1).cast("long").alias("place"),
        F.coalesce(before, F.lit(0)).alias("start"),
    )
    digest = F.sha2(F.concat_ws(":", "start", "length", "copies", "sum"), 256)
    return found.select("file", "place", "page_id", "start", "length", digest.alias("digest"))


@dataclass
class Tree:
    """Levels of one replica, leaves first; nodes are (file, place, digest), and the last level holds roots."""

    levels: list[DataFrame]


def tree(found: DataFrame, depth: int, fanout: int = FANOUT) -> Tree:
    levels = [cut(found)]
    for _ in range(depth):
        below = levels[-1].select("file", F.expr(f"place div {fanout}").alias("place"), F.struct("place", "digest").alias("child"))
        node = F.array_sort(F.collect_list("child"))  # a node has ``fanout`` children at most
        digest = F.sha2(F.array_join(F.transform(node, lambda c: c["digest"]), ","), 256)
        levels.append(cut(below.groupBy("file", "place").agg(digest.alias("digest"))))
    return Tree(levels)


def depth_for(rows: int, fanout: int = FANOUT) -> int:
    depth = 0
    while rows > 1:
        rows, depth = -(-rows // fanout), depth + 1
    return depth


def audit(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, place, page_id, start, length, state) of the records that differ between two sets of leaves.

    ``state`` is ``damaged`` (both hold a record there, with other bytes or another place in the file),
    ``missing`` (only the first does) or ``added`` (only the second does); the page and place of the record
    in the first are given, of added ones those in the second. Files that one replica lacks altogether are walked
    whole. Empty replicas agree.
    """
    longest = max((f.groupBy("file").agg(F.max("place").alias("p")).agg(F.max("p")).first()[0] or 0) + 1 for f in (first, second))
    depth = depth_for(longest, fanout)
    a, b = tree(first, depth, fanout), tree(second, depth, fanout)
    wanted = None
    for level in range(depth, -1, -1):
        sides = [t.levels[level] for t in (a, b)]
        if wanted is not None:
            sides = [side.join(wanted, (F.expr(f"place div {fanout}") == F.col("up")) & (F.col("file") == F.col("of")), "left_semi") for side in sides]
        left, right = (side.select(F.col("file").alias(f"file{k}"), F.col("place").alias(f"place{k}"), F.col("digest").alias(f"digest{k}"), *([] if level else [F.struct("page_id", "start", "length").alias(f"record{k}")])) for k, side in enumerate(sides))
        joined = left.join(right, (F.col("file0") == F.col("file1")) & (F.col("place0") == F.col("place1")), "full")
        differ = joined.where("not (digest0 <=> digest1)")
        if level:
            wanted = cut(differ.select(F.coalesce("file0", "file1").alias("of"), F.coalesce("place0", "place1").alias("up")))
    state = F.when(F.col("digest1").isNull(), "missing").when(F.col("digest0").isNull(), "added").otherwise("damaged")
    return differ.select(
        F.coalesce("file0", "file1").alias("file"), F.coalesce("place0", "place1").alias("place"), F.coalesce("record0", "record1").alias("r"), state.alias("state")
    ).select("file", "place", "r.page_id", "r.start", "r.length", "state")


def files_of(records: DataFrame) -> DataFrame:
    """(file, bytes): whole WARC files, for archives whose files fit a row; records as :func:`leaves` orders them."""
    pieces = F.array_sort(F.collect_list(F.struct("page_id", F.sha2("payload", 256).alias("sum"), "payload")))
    empty = F.lit(b"")
    joined = F.aggregate(pieces, empty, lambda found, p: F.concat(found, p["payload"]))
    return records.groupBy("file").agg(joined.alias("bytes"))


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, length, page_id, payload) of the records of whole files (file, bytes)."""
    for batch in batches:
        rows: list[tuple] = []
        for file, data in zip(batch.column("file").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            at = 0
            while at < len(data):
                end = data.index(b"\r\n\r\n", at) + 4
                head = dict(line.split(b": ", 1) for line in data[at : end - 4].split(b"\r\n")[1:])
                stop = end + int(head[b"Content-Length"]) + 4
                page = head[b"WARC-Record-ID"].removeprefix(b"<urn:page:").removesuffix(b">")
                rows.append((file, at, stop - at, int(page) if page else None, data[at:stop]))
                at = stop
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["file", "start", "length", "page_id", "payload"])


def read_files(files: DataFrame) -> DataFrame:
    return files.mapInArrow(parse, "file long, start long, length long, page_id long, payload binary")
