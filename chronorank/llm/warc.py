"""WARC records in ZIP-packaged archives, written and read back by ranges.

Of records with equal payloads of at least REVISIT bytes, that with the largest page_id is the response and the others
are revisits of it; smaller ones are all responses. Each task writes archives into the shared folder (names are new for
every attempt; only archives that a finished task reports are read). An archive is a ZIP of stored members: archive/data.warc,
indexes/index.cdxj (offset and length of each record) and datapackage.json. The reader parses the end record, the ZIP64
records and the central directory, finds the stored members and reads the records by ranges, without extraction.

Null html counts as empty; payloads of any length are written and read whole. Rows without an id are responses or revisits like others; repeated rows that hold the largest
id are all responses; an empty table gives no rows; other columns,
whatever their names, are ignored."""
import hashlib
import itertools
import json
import struct
import uuid
import zlib

from pyspark.sql import functions as F

from chronorank.llm.shared import folder, settled, small

REVISIT, ARCHIVE_BYTES, RUN = 1000, 64 << 20, 8 << 20
LIMIT16, LIMIT32 = 0xFFFF, 0xFFFFFFFF


def filesystem(uri):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id, url, html, digest, kind, refers):
    """Bytes of one WARC/1.1 record."""
    body = html if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(html)}"]
    head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(data):
    """(headers, body) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class Writer:
    """A ZIP of stored members, written front to back; the sizes stand in ZIP64 fields wherever they need to."""

    def __init__(self, stream, zip64=False):
        self.stream, self.at, self.members, self.zip64 = stream, 0, [], zip64

    def _put(self, data):
        self.stream.write(data)
        self.at += len(data)

    def member(self, name, chunks):
        """Sizes are known only after the chunks: they follow in a data descriptor."""
        start, crc, size, label = self.at, 0, 0, name.encode()
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x0808, 0, 0, 33, 0, LIMIT32, LIMIT32, len(label), 20) + label + struct.pack("<HHQQ", 1, 16, 0, 0))
        for c in chunks:
            crc, size = zlib.crc32(c, crc), size + len(c)
            self._put(c)
        self._put(struct.pack("<4sIQQ", b"PK\7\x08", crc, size, size))
        self.members.append((label, crc, size, start))

    def close(self):
        at = self.at
        for label, crc, size, start in self.members:
            big = self.zip64 or size >= LIMIT32 or start >= LIMIT32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if big else b""
            short = (LIMIT32,) * 3 if big else (size, size, start)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x0808, 0, 0, 33, crc, *short[:2], len(label), len(extra), 0, 0, 0, 0, short[2]) + label + extra)
        n, size, end = len(self.members), self.at - at, self.at
        big = self.zip64 or at >= LIMIT32 or n >= LIMIT16
        if big:
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, *((LIMIT16, LIMIT16, LIMIT32, LIMIT32) if big else (n, n, size, at)), 0))


def directory(read, size):
    """{name: (offset of the data, length)} of the stored members; read(offset, length) gives bytes."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("not a ZIP archive")
    _, _, _, _, n, length, at, _ = struct.unpack("<4sHHHHIIH", tail[end : end + 22])
    if LIMIT16 == n or LIMIT32 in (length, at):
        mark, _, there, _ = struct.unpack("<4sIQI", read(tail_at + end - 20, 20))
        if mark != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        n, length, at = struct.unpack("<4sQHHIIQQQQ", read(there, 56))[-3:]
    central, out, p = read(at, length), {}, 0
    for _ in range(n):
        f = struct.unpack("<4sHHHHHHIIIHHHHHII", central[p : p + 46])
        if f[0] != b"PK\1\2":
            raise ValueError("broken central directory")
        packed, plain, label, extra, note, start = f[8], f[9], f[10], f[11], f[12], f[16]
        name, more = central[p + 46 : p + 46 + label].decode(), central[p + 46 + label : p + 46 + label + extra]
        while len(more) >= 4:
            tag, length = struct.unpack("<HH", more[:4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{length // 8}Q", more[4 : 4 + length // 8 * 8]))
                plain, packed, start = (next(wide) if x == LIMIT32 else x for x in (plain, packed, start))
            more = more[4 + length :]
        if f[4] != 0:
            raise ValueError(f"{name} is not stored")
        local = struct.unpack("<4sHHHHHIIIHH", read(start, 30))
        out[name] = (start + 30 + local[9] + local[10], packed)
        p += 46 + label + extra + note
    return out


def _write(base):
    def run(batches):
        import pandas as pd

        place = None
        state = {"index": [], "at": 0}

        def open_():
            nonlocal place
            fs, path = filesystem(base)
            fs.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}.wacz"
            place = (f"{base}/{name}", fs.open_output_stream(f"{path}/{name}"))

        def records(pages):
            while state["at"] < ARCHIVE_BYTES and (r := next(pages, None)) is not None:
                data = record(*r)
                state["index"].append((r[0], state["at"], len(data)))
                state["at"] += len(data)
                yield data

        def pages():
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    yield r.page_id, r.url, (r.html if isinstance(r.html, str) else "").encode("utf-8", "surrogatepass"), r.digest, r.kind, r.refers

        todo = pages()
        while (r := next(todo, None)) is not None:
            todo = itertools.chain([r], todo)
            open_()
            state.update(index=[], at=0)
            z = Writer(place[1])
            z.member("archive/data.warc", records(todo))
            z.member("indexes/index.cdxj", (f"page:{i} 19700101000000 {json.dumps({'offset': str(a), 'length': str(n)})}\n".encode() for i, a, n in state["index"]))
            z.member("datapackage.json", [json.dumps({"profile": "data-package", "records": len(state["index"])}).encode()])
            z.close()
            place[1].close()
            yield pd.DataFrame({"uri": [place[0]], "size": [z.at]})

    return run


def read_archive(uri):
    """(headers, body) of every record, in the order of the index; neighbours are read in runs of at most RUN bytes."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        read = lambda at, n: f.read_at(n, at)
        there = directory(read, f.size())
        base, _ = there["archive/data.warc"]
        index = [json.loads(x.split(b" ", 2)[2]) for x in read(*there["indexes/index.cdxj"]).splitlines()]
        spots = [(int(x["offset"]), int(x["length"])) for x in index]
        i = 0
        while i < len(spots):
            j, start = i + 1, spots[i][0]
            while j < len(spots) and sum(spots[j]) - start <= RUN:
                j += 1
            data = read(base + start, sum(spots[j - 1]) - start)
            for at, n in spots[i:j]:
                yield parse(data[at - start : at - start + n])
            i = j


def _read(batches):
    import pandas as pd

    for pdf in batches:
        for uri in pdf["uri"]:
            rows = []
            for head, body in read_archive(uri):
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"broken payload in {uri}: {head['WARC-Record-ID']}")
                rows.append((head["WARC-Record-ID"][10:-1], int(head["X-Payload-Length"]), digest, kind, head.get("WARC-Refers-To", "")[10:-1]))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def typed(pages):
    """page_id (as text), url, html, digest, kind and refers of every row."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    d = pages.select(F.col("page_id").cast("long").alias("id"), "url", "html", F.sha1(payload).alias("digest"), F.length(payload).alias("n"))
    keys = d.where(f"n >= {REVISIT}").select("id", "digest")
    many = keys.groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("c")).where("c > 1 and last is not null").select(F.col("digest").alias("d2"), "last")
    many = small(settled(many))  # beyond the bound a sort-merge join, which adaptive execution splits where it is skewed
    d = d.join(many, (F.col("digest") == F.col("d2")) & (F.col("n") >= REVISIT), "left")
    kind = F.when(F.col("last").isNull() | F.col("id").eqNullSafe(F.col("last")), "response").otherwise("revisit")
    return d.select(F.col("id").cast("string").alias("page_id"), "url", "html", "digest", kind.alias("kind"), F.when(kind == "revisit", F.col("last").cast("string")).alias("refers"))


def roundtrip(pages):
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives."""
    archives = settled(typed(pages).mapInPandas(_write(folder(pages.sparkSession)), "uri string, size long"))
    tasks = max(1, min(archives.count(), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # a task reads some archives, one after the other
    back = archives.repartition(tasks, "uri").mapInPandas(_read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return back.withColumn("page_id", F.expr("try_cast(page_id as long)")).withColumn("refers_to", F.expr("try_cast(refers_to as long)"))
