"""WARC records, files of them, and their Merkle fixity audit.

Record bytes are laid out in files of RECORDS_PER_FILE consecutive pages; a record's offset is the running length in
its file. Leaves are SHA-256 digests of records. A leaf belongs to the offset range offset // RANGE_BYTES of its file;
a range's digest hashes its leaves in offset order, a block FANOUT consecutive ranges, a file its blocks, a shelf
FILES_PER_SHELF files, and the root the shelves. An audit compares the replicas' roots and ends there if they are equal;
otherwise only the children of a node whose digests differ are joined at the next level, down to ranges. Within ranges
that differ records meet by id and digest, so a record that is missing or was added is reported alone, though it moves
the offsets of all that follow in its file.

Edge cases: a null url or body is an empty one; pages with a null id have files of their own, dealt by a hash of their
content; repeated ids are ordered by digest, and as many records of an id and digest match as both replicas hold; empty
replicas agree; other columns, of whatever name, are not looked at. Ids are numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small
from .mixing import id_hash

RECORDS_PER_FILE = 1024
#: Files, numbered below 0, that pages without an id are dealt to.
NULL_FILES = 1 << 20
RANGE_BYTES = 1 << 16
FANOUT = 16
FILES_PER_SHELF = 256
#: Key columns of the tree's levels below the root, from the top.
LEVELS = (["shelf"], ["shelf", "file"], ["shelf", "file", "block"], ["shelf", "file", "block", "range"])
#: WARC-Date of records whose pages tell no time.
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.0\r\n"
FAULTS = "page_id long, file long, status string, digest string, replica_digest string"


def records(pages: DataFrame, per_file: int = RECORDS_PER_FILE, date: str = DATE) -> DataFrame:
    """file, seq, offset, length, digest, page_id, record: WARC/1.0 response records of a pages table.

    The window sorts at most per_file records (ids, not bodies, decide the file)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    url = F.coalesce(F.col("url"), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    file = F.coalesce(F.floor(F.col("page_id") / per_file), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(NULL_FILES))).cast("long")
    r = pages.select(F.col("page_id").cast("long").alias("page_id"), file.alias("file"), F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))
    r = r.withColumn("length", F.octet_length("record").cast("long")).withColumn("digest", F.sha2(F.col("record"), 256))
    w = Window.partitionBy("file").orderBy("page_id", "digest")
    r = r.withColumn("seq", F.row_number().over(w).cast("long"))
    return r.withColumn("offset", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def write_warc(recs: DataFrame, path: str) -> None:
    """Files of record bytes: a folder file=n for each file number, its records in order in one file. Read their
    numbers, offsets and digests again with read_warc."""
    # the line separator is a record's last line break
    rows = recs.repartition("file").sortWithinPartitions("file", "seq").select("file", F.expr("left(record, length(record) - 2)").alias("value"))
    rows.write.partitionBy("file").option("lineSep", "\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, offset, length, digest, page_id, url, html of the files that write_warc made. A record's extent is
    told by its Content-Length, whatever its body holds; a task parses whole files. A file that isn't a sequence of
    records raises an error with its name and the offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                number = int(name.rsplit("file=", 1)[1].split("/", 1)[0])
                rows: dict[str, list] = {c: [] for c in ("file", "seq", "offset", "length", "digest", "page_id", "url", "html")}
                at = 0
                while at < len(data):
                    stop = data.find(b"\r\n\r\n", at)
                    fields = dict(x.split(b": ", 1) for x in data[at + len(VERSION) : stop].split(b"\r\n")) if stop >= 0 and data.startswith(VERSION, at) else {}
                    if b"Content-Length" not in fields:
                        raise ValueError(f"no WARC record at {at} of {name}")
                    body = stop + 4
                    end = body + int(fields[b"Content-Length"])
                    if data[end : end + 4] != b"\r\n\r\n":
                        raise ValueError(f"record at {at} of {name} has no end at {end}")
                    page = fields.get(b"WARC-Record-ID", b"")[len(b"<urn:page:") : -1]
                    raw = data[at : end + 4]
                    new = (number, len(rows["seq"]) + 1, at, len(raw), hashlib.sha256(raw).hexdigest(), int(page) if page else None, fields.get(b"WARC-Target-URI", b"").decode(), data[body:end].decode())
                    for c, v in zip(rows, new, strict=True):
                        rows[c].append(v)
                    at = end + 4
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(c, pa.string() if c in ("digest", "url", "html") else pa.int64()) for c in rows]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, "file long, seq long, offset long, length long, digest string, page_id long, url string, html string")


def leaves(recs: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Record digests with the keys of every tree level above them."""
    at = F.floor(F.col("offset") / range_bytes).cast("long")
    return recs.select(
        F.floor(F.col("file") / FILES_PER_SHELF).cast("long").alias("shelf"), "file", F.floor(at / fanout).cast("long").alias("block"), at.alias("range"),
        "seq", "offset", "length", "page_id", "digest",
    )


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Digests of the levels in LEVELS, then of the root. A node hashes its children's keys and digests in order;
    it gathers the records of one offset range, fanout ranges, one file's blocks or one shelf's files."""

    def up(below: DataFrame, keys: list[str], child: str) -> DataFrame:
        kids = F.array_sort(F.collect_list(F.struct(F.col(child).alias("k"), "digest")))
        text = F.array_join(F.transform(kids, lambda x: F.concat_ws(":", x["k"], x["digest"])), ",")
        return below.groupBy(*keys).agg(F.sha2(text, 256).alias("digest"))

    levels = [materialize(up(leaf, LEVELS[-1], "offset"))]
    for keys, child in zip(LEVELS[-2::-1], ("range", "block", "file"), strict=True):
        levels.insert(0, up(levels[0], keys, child))
    return [*levels, up(levels[0], [], "shelf")]


def root(leaf: DataFrame) -> DataFrame:
    return tree(leaf)[-1]


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """FAULTS of two replicas' leaves: changed (an id's record has another digest), missing (only the primary has it),
    added (only the replica has it) or moved (the same record at another place among the records that both have).

    Roots are compared first; a level joins only what lies below the nodes that differ one level up."""
    spark = primary.sparkSession
    primary, replica = materialize(primary), materialize(replica)
    a, b = tree(primary), tree(replica)
    if a[-1].first() == b[-1].first():
        return spark.createDataFrame([], FAULTS)
    differ: DataFrame | None = None
    for level, keys in enumerate(LEVELS):
        x, y = a[level], b[level]
        if differ is not None:
            x, y = x.join(small(differ), LEVELS[level - 1], "left_semi"), y.join(small(differ), LEVELS[level - 1], "left_semi")
        x, y = x.select(*keys, F.col("digest").alias("da")), y.select(*keys, F.col("digest").alias("db"))
        differ = materialize(x.join(y, keys, "full_outer").filter(~F.col("da").eqNullSafe(F.col("db"))).select(*keys))
    # records alike meet first, as many of an id and digest as both hold
    alike = Window.partitionBy("file", "page_id", "digest").orderBy("seq")
    x, y = (leaf.join(small(differ), LEVELS[-1], "left_semi").select("file", "page_id", "digest", "seq", F.row_number().over(alike).alias("k")) for leaf in (primary, replica))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("file", "page_id", "digest", "k")]
    met = x.alias("x").join(y.alias("y"), same, "full_outer")
    met = materialize(met.select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("file", "page_id", "digest")], F.col("x.seq").alias("sx"), F.col("y.seq").alias("sy")))
    place = [F.row_number().over(Window.partitionBy("file").orderBy(s)) for s in ("sx", "sy")]
    both = met.filter("sx is not null and sy is not null").withColumns({"px": place[0], "py": place[1]}).filter("px <> py")
    moved = both.select("page_id", "file", F.lit("moved").alias("status"), "digest", F.col("digest").alias("replica_digest"))
    # then the rest of one id
    rest = Window.partitionBy("file", "page_id").orderBy("digest")
    left, right = (met.filter(only).select("file", "page_id", "digest", F.row_number().over(rest).alias("k")) for only in ("sy is null", "sx is null"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("file", "page_id", "k")]
    found = left.alias("x").join(right.alias("y"), same, "full_outer")
    status = F.when(F.col("y.digest").isNull(), "missing").when(F.col("x.digest").isNull(), "added").otherwise("changed")
    found = found.select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("page_id", "file")], status.alias("status"), F.col("x.digest").alias("digest"), F.col("y.digest").alias("replica_digest"))
    return found.unionByName(moved)


def fixity(pages: DataFrame, replica_pages: DataFrame) -> DataFrame:
    """page_id, file, offset, length, digest, status, intact: a row for each record of the primary replica and for each
    one that was added in the other (without offset and length, with the digest that it has there)."""
    leaf = materialize(leaves(records(pages)))
    bad = materialize(audit(leaf, leaves(records(replica_pages))))
    mine = Window.partitionBy("file", "page_id", "digest").orderBy("seq")
    hurt = bad.filter("digest is not null").groupBy("file", "page_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("status").alias("status"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("file", "page_id", "digest")]
    # of records alike, as many as are hurt
    out = leaf.withColumn("k", F.row_number().over(mine)).alias("l").join(small(materialize(hurt)).alias("h"), same, "left")
    status = F.when(F.col("k") <= F.col("h.n"), F.col("h.status")).otherwise("intact")
    out = out.select("l.page_id", "l.file", "l.offset", "l.length", "l.digest", status.alias("status"))
    added = bad.filter("status = 'added'").select("page_id", "file", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"), F.col("replica_digest").alias("digest"), "status")
    return out.unionByName(added).withColumn("intact", F.col("status") == "intact")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages (page_id, url, html) with four kinds of faults (fault injection, by hashes of ids): about one
    body in 211 has its first character overwritten, one page in 223 is missing, one in 227 has a second record, and
    one neighbouring pair of ids in 101 has its bodies exchanged."""
    p = pages.select("page_id", "url", "html")
    other = F.col("page_id").bitwiseXOR(F.lit(1))
    swapped = id_hash(F.shiftright(F.col("page_id").cast("long"), 1)) % 101 == 3
    hurt = p.filter(swapped).select(other.alias("_to"), F.col("html").alias("_html"))
    # only the bodies that are exchanged are shuffled
    pair = p.filter(swapped).join(hurt, F.col("page_id") == F.col("_to"), "left")
    pair = pair.select("page_id", "url", F.when(F.col("_to").isNotNull(), F.col("_html")).otherwise(F.col("html")).alias("html"))
    p = p.filter(~swapped).unionByName(pair)
    h = id_hash(F.col("page_id"))
    text = F.when((h % 211 == 7) & (F.length("html") > 0), F.concat(F.lit("~"), F.substring("html", 2, 2147483647))).otherwise(F.col("html"))
    kept = p.filter(h % 223 != 11).select("page_id", "url", text.alias("html"))
    return kept.unionByName(kept.filter(h % 227 == 13).select("page_id", F.concat("url", F.lit("#again")).alias("url"), "html"))


SQL = r"""
WITH p AS (SELECT page_id, url, html FROM pages),
h AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h,
             CAST('0x' || substr(md5(coalesce(CAST(page_id >> 1 AS VARCHAR), '')), 1, 8) AS BIGINT) % 101 = 3 AS swapped FROM p),
s AS (SELECT a.page_id, a.url, a.h, CASE WHEN a.swapped AND b.page_id IS NOT NULL THEN b.html ELSE a.html END AS html
      FROM h a LEFT JOIN h b ON a.swapped AND b.page_id = xor(a.page_id, 1)),
k AS (SELECT page_id, url, h, CASE WHEN h % 211 = 7 AND length(html) > 0 THEN '~' || substr(html, 2) ELSE html END AS html FROM s WHERE h % 223 <> 11),
both_replicas AS (SELECT 1 AS replica, page_id, url, html FROM p UNION ALL SELECT 2, page_id, url, html FROM k
                  UNION ALL SELECT 2, page_id, url || '#again', html FROM k WHERE h % 227 = 13),
r AS (
  SELECT replica, page_id, CAST(floor(page_id / 1024) AS BIGINT) AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>'
    || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM both_replicas),
d AS (SELECT replica, page_id, file, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest FROM r),
o AS (SELECT *, CAST(sum(length) OVER (PARTITION BY replica, file ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset",
             row_number() OVER (PARTITION BY replica, page_id, digest) AS i FROM d),
m AS (SELECT a.page_id, a.file, a."offset", a.length, a.digest, b.digest IS NOT NULL AS intact
      FROM o a LEFT JOIN o b ON b.replica = 2 AND b.page_id = a.page_id AND b.digest = a.digest AND b.i = a.i WHERE a.replica = 1),
new AS (SELECT b.* FROM o b LEFT JOIN o a ON a.replica = 1 AND a.page_id = b.page_id AND a.digest = b.digest AND a.i = b.i WHERE b.replica = 2 AND a.page_id IS NULL),
x AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY digest) AS j FROM m WHERE NOT intact),
y AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY digest) AS j FROM new)
SELECT page_id, file, "offset", length, digest, 'intact' AS status, true AS intact FROM m WHERE intact
UNION ALL SELECT x.page_id, x.file, x."offset", x.length, x.digest, CASE WHEN y.page_id IS NULL THEN 'missing' ELSE 'changed' END, false FROM x LEFT JOIN y ON x.page_id = y.page_id AND x.j = y.j
UNION ALL SELECT y.page_id, y.file, NULL, NULL, y.digest, 'added', false FROM y LEFT JOIN x ON x.page_id = y.page_id AND x.j = y.j WHERE x.page_id IS NULL
"""
