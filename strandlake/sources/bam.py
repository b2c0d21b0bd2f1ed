"""Alignments from BAM files, as a Python data source: spark.read.format("bam").option("paths", "a.bam,b.bam").load().

The layout is that of the public SAM/BAM specification: gzip members around a header and length-prefixed records. A file with an
index beside it (`x.bam.bai` or `x.bai`) is read by several partitions, and for regions only where the index says that they may be;
without one, a partition reads a whole file. Each streams and keeps a batch of records at a time, and decodes those it returns only.
The index is read by the tasks; the driver only asks for file sizes. Comparisons of sample, path, rname, pos0, end0, mapq and flag
with constants are pushed into the scan: they choose files and blocks, and skip records before they are decoded. To read much of a
file more than once, write it to Parquet sorted by rname and pos0.
"""

from __future__ import annotations

import json
import operator
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

SCHEMA = "sample string, path string, qname string, flag int, rname string, pos0 long, end0 long, mapq int, cigar array<struct<op: int, len: int>>, cigar_str string, rnext string, pnext0 long, seq string, quals array<int>"
#: Fixed values of the format.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Fixed values of its index: levels of bins as (first bin, shift of a position), the shift of a linear window, the bin of totals.
LEVELS, LINEAR, TOTALS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)), 14, 37450
BATCH = 5_000
#: Compressed bytes a partition of an indexed file.
SHARE = 64 << 20


def _inflate(stream, at: int = 0, block_size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Pieces of the text with the place of their gzip member, from the member at `at`."""
    stream.seek(at)
    z, member, fed = zlib.decompressobj(31), at, at
    while block := stream.read(block_size):
        while block:
            piece = z.decompress(block)
            fed += len(block) - len(z.unused_data)
            block = z.unused_data
            yield member, piece
            if z.eof:
                z, member = zlib.decompressobj(31), fed


class _Bytes:
    """read(n) over pieces; virtual places are (place of a member) << 16 | (offset inside)."""

    def __init__(self, pieces: Iterator[tuple[int, bytes]], end: int | None = None):
        self.pieces, self.held, self.used = pieces, bytearray(), 0
        self.end, self.stop = end, None
        #: (bytes before it, place) of members met and not yet passed
        self.members: list[tuple[int, int]] = []

    def fill(self, n: int) -> None:
        while len(self.held) < n and (more := next(self.pieces, None)) is not None:
            total = self.used + len(self.held)
            if not self.members or self.members[-1][1] != more[0]:
                self.members.append((total, more[0]))
                if self.end is not None and self.stop is None and more[0] >= self.end >> 16:
                    self.stop = total + (self.end & 0xFFFF if more[0] == self.end >> 16 else 0)
            self.held += more[1]

    def read(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.held[:n])
        del self.held[:n]
        self.used += len(out)
        return out

    def place(self) -> int:
        """Virtual place of the next byte."""
        self.fill(1)
        while len(self.members) > 1 and self.members[1][0] <= self.used:
            self.members.pop(0)
        first, member = self.members[0]
        return member << 16 | self.used - first

    def records(self) -> Iterator[bytes]:
        """Records up to the end given."""
        while True:
            self.fill(4)
            if len(self.held) < 4 or self.stop is not None and self.used >= self.stop:
                return
            rec = self.read(struct.unpack("<i", self.read(4))[0])
            while len(self.members) > 1 and self.members[1][0] <= self.used:
                self.members.pop(0)
            yield rec


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _stream(path: str):
    store, place = _store(path)
    return store.open_input_file(place)


def index_path(path: str) -> str | None:
    """The index beside a file, if there is one."""
    for found in (path + ".bai", path.removesuffix(".bam") + ".bai"):
        store, place = _store(found)
        if store.get_file_info(place).is_file:
            return found
    return None


class Regions:
    """Disjoint (start, end) by contig number; says whether a stretch meets any. Regions without length meet nothing."""

    def __init__(self, regions: list[tuple[int, int, int]]):
        self.by: dict[int, tuple[list[int], list[int]]] = {}
        for contig, a, b in sorted(regions):
            if a >= b:
                continue
            starts, ends = self.by.setdefault(contig, ([], []))
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)

    def meets(self, contig: int, start: int, end: int) -> bool:
        starts, ends = self.by.get(contig, ((), ()))
        k = bisect_right(ends, start)
        return k < len(ends) and starts[k] < end

    def flat(self) -> list[tuple[int, int, int]]:
        return [(c, a, b) for c, (starts, ends) in self.by.items() for a, b in zip(starts, ends)]


def _bins_of(start: int, end: int) -> list[range]:
    return [range(first + (start >> shift), first + (end - 1 >> shift) + 1) for first, shift in LEVELS]


@dataclass
class Index:
    """Per contig: bins with their chunks of virtual places, and the least place by linear window."""

    contigs: list[tuple[dict[int, list[tuple[int, int]]], list[int]]]
    #: Records without an alignment among a contig's own, where the index tells.
    unmapped: list[int | None]

    @classmethod
    def read(cls, path: str) -> Index:
        with _stream(path) as f:
            data = f.read()
        if data[:4] != b"BAI\1":
            raise ValueError(f"no BAM index: {path}")
        at = 4

        def take(form: str):
            nonlocal at
            out = struct.unpack_from("<" + form, data, at)
            at += struct.calcsize("<" + form)
            return out

        contigs, unmapped = [], []
        for _ in range(take("i")[0]):
            bins, without = {}, None
            for _ in range(take("i")[0]):
                number, n = take("Ii")
                flat = take(f"{2 * n}Q")
                if number != TOTALS:
                    bins[number] = list(zip(flat[::2], flat[1::2]))
                else:
                    without = flat[3]
            contigs.append((bins, list(take(f"{take('i')[0]}Q"))))
            unmapped.append(without if bins or without is not None else 0)
        return cls(contigs, unmapped)

    def starts(self) -> list[int]:
        """Places where a record begins, ascending."""
        return sorted({a for bins, _ in self.contigs for chunks in bins.values() for a, _ in chunks} | {p for _, linear in self.contigs for p in linear if p})

    def tail(self, first: int) -> int:
        """Where the records without a contig begin at the earliest."""
        return max((b for bins, _ in self.contigs for chunks in bins.values() for _, b in chunks), default=first)

    def chunks(self, regions: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """Disjoint ranges of places that hold every record that overlaps a region (contig number, start, end)."""
        found = []
        for contig, start, end in regions:
            start, end = max(start, 0), min(end, 1 << 29)
            if start >= end or not 0 <= contig < len(self.contigs):
                continue
            bins, linear = self.contigs[contig]
            window = start >> LINEAR
            least = linear[window] if window < len(linear) else linear[-1] if linear else 0
            wanted = _bins_of(start, end)
            found += [(max(a, least), b) for number, chunks in bins.items() if any(number in r for r in wanted) for a, b in chunks if b > least]
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


def write_index(path: str) -> str:
    """Write `path`.bai for a local file sorted by contig and position."""
    with _stream(path) as f:
        source = _Bytes(_inflate(f))
        contigs = header(source)
        found, last, counts = [({}, {}) for _ in contigs], (0, -1), [[0, 0] for _ in contigs]
        at = source.place()
        for rec in source.records():
            after = source.place()
            ref, start, end = _where(rec)
            if ref >= 0:
                if (ref, start) < last:
                    raise ValueError(f"not sorted by position: {path}")
                last = (ref, start)
                counts[ref][bool(_flag(rec) & 4)] += 1
                bins, linear = found[ref]
                number = next(r.start for r in reversed(_bins_of(start, end)) if len(r) == 1)
                chunks = bins.setdefault(number, [])
                if chunks and chunks[-1][1] == at:
                    chunks[-1] = (chunks[-1][0], after)
                else:
                    chunks.append((at, after))
                for w in range(start >> LINEAR, (end - 1 >> LINEAR) + 1):
                    linear.setdefault(w, at)
            at = after
    out = bytearray(b"BAI\1" + struct.pack("<i", len(found)))
    for (bins, linear), count in zip(found, counts):
        spans = [c for chunks in bins.values() for c in chunks]
        every = [*bins.items(), *([(TOTALS, [(min(spans)[0], max(b for _, b in spans)), tuple(count)])] if spans else [])]
        out += struct.pack("<i", len(every))
        for number, chunks in every:
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        places, least = [], 0
        for w in range(max(linear, default=-1) + 1):
            least = linear.get(w, least)
            places.append(least)
        out += struct.pack(f"<i{len(places)}Q", len(places), *places)
    with open(path + ".bai", "wb") as f:
        f.write(out)
    return path + ".bai"


def header(source: _Bytes) -> list[tuple[str, int]]:
    """Contig names and lengths."""
    if source.read(4) != b"BAM\1":
        raise ValueError("no BAM file")
    source.read(struct.unpack("<i", source.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", source.read(4))[0]):
        name = source.read(struct.unpack("<i", source.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", source.read(4))[0]))
    return out


def _where(rec: bytes) -> tuple[int, int, int]:
    """Contig number, start and end of a record."""
    ref, pos, n_name, _, _, n_cigar = struct.unpack_from("<iiBBHH", rec)
    codes = struct.unpack_from(f"<{n_cigar}I", rec, 32 + n_name)
    return ref, pos, pos + max(sum(c >> 4 for c in codes if c & 15 in (0, 2, 3, 7, 8)), 1)


def _flag(rec: bytes) -> int:
    return struct.unpack_from("<H", rec, 14)[0]


def parse(rec: bytes, contigs: list[tuple[str, int]]) -> tuple:
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, nref, npos, _ = struct.unpack_from("<iiBBHHHiiii", rec)
    at = 32 + n_name
    codes = struct.unpack_from(f"<{n_cigar}I", rec, at)
    at += 4 * n_cigar
    packed = rec[at : at + (n_seq + 1) // 2]
    at += (n_seq + 1) // 2
    quals = rec[at : at + n_seq]
    cigar = [{"op": c & 15, "len": c >> 4} for c in codes]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq] or None
    covered = sum(c["len"] for c in cigar if c["op"] in (0, 2, 3, 7, 8))
    name = lambda k: contigs[k][0] if k >= 0 else None
    return rec[32 : 32 + n_name - 1].decode(), flag, name(ref), pos, pos + max(covered, 1), mapq, cigar or None, "".join(f"{c['len']}{OPS[c['op']]}" for c in cigar) or "*", name(nref), npos, seq, None if not quals or quals[0] == 255 else list(quals)


@dataclass
class Part(InputPartition):
    """Share k of n of a file; n is 1 without an index."""

    path: str
    index: str | None = None
    k: int = 0
    n: int = 1


#: Comparisons that the scan takes over, as (name of the filter's class, test).
TESTS = {c.__name__: f for c, f in ((EqualTo, operator.eq), (GreaterThan, operator.gt), (GreaterThanOrEqual, operator.ge), (LessThan, operator.lt), (LessThanOrEqual, operator.le), (In, lambda x, y: x in y), (IsNotNull, None), (IsNull, None))}
OF_FILES, OF_RECORDS = ("sample", "path"), ("rname", "pos0", "end0", "mapq", "flag")


def _holds(value, kind: str, other) -> bool:
    if kind in ("IsNull", "IsNotNull"):
        return (value is None) == (kind == "IsNull")
    return value is not None and TESTS[kind](value, other)


def sample_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".bam")


class BamReader(DataSourceReader):
    def __init__(self, options):
        #: (column, name of a test, constant), all of which hold for what is read
        self.tests: list[tuple] = []
        self.unmapped = str(options.get("unmapped", "")).lower() == "true"
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split(",") if p]
        self.share = int(options.get("share", SHARE))
        self.regions = None
        if options.get("regions") is not None:
            self.regions = [tuple(r) for r in json.loads(options["regions"])]
        elif options.get("chrom") is not None:
            self.regions = [(options["chrom"], int(options.get("start", 0)), int(options.get("end", 1 << 40)))]

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            comparable = type(f).__name__ in ("IsNull", "IsNotNull") or value is not None
            if type(f).__name__ in TESTS and column in OF_FILES + OF_RECORDS and comparable:
                self.tests.append((column, type(f).__name__, tuple(value) if isinstance(value, (list, tuple)) else value))
            else:
                yield f

    def pushed_regions(self) -> list[tuple[str, int, int]] | None:
        """Where records lie that pass the tests of rname, pos0 and end0; None if no contig is named."""
        named = None
        lo, hi = 0, 1 << 40
        for column, kind, value in self.tests:
            if column == "rname" and kind in ("EqualTo", "In"):
                own = {value} if kind == "EqualTo" else set(value)
                named = own if named is None else named & own
            # a record from pos0 on overlaps the position pos0, and one up to end0 the position before it
            elif column == "pos0" and kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual"):
                lo = max(lo, value)
            elif column == "end0" and kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual"):
                lo = max(lo, value - 1)
            if column == "pos0" and kind in ("EqualTo", "LessThan", "LessThanOrEqual"):
                hi = min(hi, value + 1)
            elif column == "end0" and kind in ("EqualTo", "LessThan", "LessThanOrEqual"):
                hi = min(hi, value + 1)
        return None if named is None else [(c, lo, hi) for c in sorted(named - {None})]

    def partitions(self):
        out = []
        for path in self.paths:
            own = {"sample": sample_of(path), "path": path}
            if not all(_holds(own[c], kind, value) for c, kind, value in self.tests if c in OF_FILES):
                continue
            index = index_path(path)
            store, place = _store(path)
            n = max(1, -(-store.get_file_info(place).size // self.share)) if index else 1
            out += [Part(path, index, k, n) for k in range(n)]
        return out or [Part("")]  # Spark reads a source without partitions as one that doesn't know any

    def ranges(self, part: Part, first: int, regions: Regions | None) -> list[tuple[int, int | None]]:
        """Ranges of virtual places that this share reads; `first` is that of the first record. None is the end of the file."""
        if not part.index:
            return [(first, None)]
        index = Index.read(part.index)
        lo, hi = part.k * self.share << 16, (part.k + 1) * self.share << 16
        starts = index.starts()
        cuts = [first, *(p for p in starts if p > first)]
        # a share begins at the first known record at or after its first byte
        begin = first if part.k == 0 else next((p for p in cuts if p >= lo), None)
        end = None if part.k == part.n - 1 else next((p for p in cuts if p >= hi), None)
        if begin is None or begin == end:
            return []
        if regions is None and not self.unmapped:
            return [(begin, end)]
        wanted = index.chunks(regions.flat()) if regions is not None else []
        if self.unmapped:
            # contigs that hold unmapped records, or may hold some, and what follows all contigs
            wanted = [(min(a for a, _ in spans), max(b for _, b in spans)) for (bins, _), n in zip(index.contigs, index.unmapped) if n != 0 and (spans := [c for chunks in bins.values() for c in chunks])]
            wanted.append((index.tail(first), 1 << 63))
        clipped = [(max(a, begin), min(b, end if end is not None else 1 << 63)) for a, b in wanted]
        return [(a, None if b == 1 << 63 else b) for a, b in clipped if a < b]

    def read(self, partition):
        import pyarrow as pa

        path = partition.path
        if not path:
            return
        sample = sample_of(path)
        rows = []
        with _stream(path) as f:
            source = _Bytes(_inflate(f, 0, 1 << 16))
            contigs = header(source)
            source.fill(1)
            if not source.held:
                return
            for rec in self.wanted(f, partition, source.place(), contigs):
                rows.append((sample, path, *parse(rec, contigs)))
                if len(rows) == BATCH:
                    yield self.batch(pa, rows)
                    rows = []
        if rows:
            yield self.batch(pa, rows)

    def wanted(self, f, part: Part, first: int, contigs: list[tuple[str, int]]) -> Iterator[bytes]:
        """Records of a share that overlap a region and pass the tests; or those without an alignment."""
        numbers = {name: k for k, (name, _) in enumerate(contigs)}
        numbered = lambda rows: None if rows is None else Regions([(numbers[c], a, b) for c, a, b in rows if c in numbers])
        regions, pushed = numbered(self.regions), numbered(self.pushed_regions())
        within = [r for r in (regions, pushed) if r is not None]
        tests = [(OF_RECORDS.index(c), kind, value) for c, kind, value in self.tests if c in OF_RECORDS]
        narrow = within[-1] if within and not self.unmapped else None
        beyond = max(((c, b) for c, _, b in narrow.flat()), default=(0, 0)) if narrow is not None else None
        for begin, end in self.ranges(part, first, narrow):
            source = _Bytes(_inflate(f, begin >> 16, 1 << 20 if end is None else 1 << 17), end)
            source.read(begin & 0xFFFF)
            for rec in source.records():
                if not (within or tests or self.unmapped):
                    yield rec
                    continue
                ref, start, stop = _where(rec)
                if narrow is not None and part.index and (ref, start) >= beyond:  # an indexed file is sorted: nothing to find from here on
                    return
                if self.unmapped and not _flag(rec) & 4 or not all(r.meets(ref, start, stop) for r in within):
                    continue
                if tests:
                    own = (contigs[ref][0] if ref >= 0 else None, start, stop, rec[9], _flag(rec))
                    if not all(_holds(own[k], kind, value) for k, kind, value in tests):
                        continue
                yield rec

    @staticmethod
    def batch(pa, rows):
        cigar = pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())]))
        kinds = [pa.string()] * 3 + [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), cigar, pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32())]
        names = "sample path qname flag rname pos0 end0 mapq cigar cigar_str rnext pnext0 seq quals".split()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


class BamSource(DataSource):
    """Options: paths (comma-separated) or path; chrom, start, end (half-open), or regions, a JSON list of them, for the records that
    overlap any, each once; unmapped, for the records without an alignment only; share, the compressed bytes a partition of an indexed file."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def alignments(spark, paths: list[str], chrom: str | None = None, start: int | None = None, end: int | None = None, regions: list[tuple[str, int, int]] | None = None, unmapped: bool = False):
    """Records of BAM files; only those that overlap a region, or any of several, if given. Records without a contig have no region.

    unmapped: only records without an alignment; of an indexed file the contigs that hold some, by the index's totals, and the tail.
    The session's setting for pushing filters into Python sources is turned on.
    """
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("bam").option("paths", ",".join(paths))
    for k, v in (("chrom", chrom), ("start", start), ("end", end), ("regions", None if regions is None else json.dumps(regions)), ("unmapped", "true" if unmapped else None)):
        reader = reader.option(k, v) if v is not None else reader
    return reader.load()


def contig_lengths(spark, paths: list[str]):
    """path, rname, length from the headers, read on the executors."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                with _stream(p) as f:
                    rows += [(p, n, k) for n, k in header(_Bytes(_inflate(f)))]
            yield pd.DataFrame(rows, columns=["path", "rname", "length"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(run, "path string, rname string, length long")


def write_bam(path: str, contigs: list[tuple[str, int]], records: list[dict]) -> None:
    """A small BAM file, for tests and conversion: records have the columns of SCHEMA but for sample, path and end0."""
    out = bytearray(b"BAM\1" + struct.pack("<ii", 0, len(contigs)))
    ids = {None: -1} | {n: k for k, (n, _) in enumerate(contigs)}
    for n, k in contigs:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    for r in records:
        seq, name = r["seq"] or "", r["qname"].encode() + b"\0"
        codes = [BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        cigar = [c["len"] << 4 | c["op"] for c in r["cigar"] or []]
        quals = bytes(r["quals"]) if r["quals"] else b"\xff" * len(seq)
        rec = struct.pack("<iiBBHHHiiii", ids[r["rname"]], r["pos0"], len(name), r["mapq"], 0, len(cigar), r["flag"], len(seq), ids[r["rnext"]], r["pnext0"], 0)
        rec += name + struct.pack(f"<{len(cigar)}I", *cigar) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + quals
        out += struct.pack("<i", len(rec)) + rec
    with open(path, "wb") as f:
        for at in range(0, len(out), 60_000):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            f.write(z.compress(bytes(out[at : at + 60_000])) + z.flush())
