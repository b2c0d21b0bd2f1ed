"""Indexed reads of BAM files: the same records as a whole scan, from their own blocks only."""

import random

import pytest

from strandlake.sources import bam

CONTIGS = [("c1", 3_000_000), ("c2", 400_000), ("empty", 1000)]


@pytest.fixture(scope="module")
def records():
    r = random.Random(3)
    rows = []
    for contig, length in CONTIGS[:2]:
        for k, pos in enumerate(sorted(r.randrange(length - 60_000) for _ in range(12_000))):
            cigar = [(50, 0)] if k % 997 else [(20, 0), (50_000, 3), (30, 0)]
            rows.append({"qname": f"{contig}_{k}", "flag": 0, "rname": contig, "pos0": pos, "mapq": 60, "cigar": [{"op": o, "len": n} for n, o in cigar], "rnext": contig, "pnext0": pos, "seq": "".join(r.choices("ACGT", k=50)), "quals": [30] * 50})
    rows += [dict(rows[0], qname=f"lost{k}", rname=None, rnext=None, pos0=-1, pnext0=-1, flag=4, cigar=[]) for k in range(50)]
    return rows


@pytest.fixture(scope="module")
def paths(tmp_path_factory, records):
    out = []
    for name in ("indexed", "bare"):
        path = f"{tmp_path_factory.mktemp(name)}/s.bam"
        bam.write_bam(path, CONTIGS, records)
        out.append(path)
    bam.write_index(out[0])
    return out


def names(options):
    reader = bam.BamReader(options)
    return [n for part in reader.partitions() for batch in reader.read(part) for n in batch.column("qname").to_pylist()]


def overlapping(records, regions):
    end = lambda r: r["pos0"] + max(sum(c["len"] for c in r["cigar"]), 1)
    return [r["qname"] for r in records if any(r["rname"] == c and r["pos0"] < b and end(r) > a for c, a, b in regions)]


@pytest.mark.parametrize("share", [5_000, 100_000, 1 << 30])
def test_shares_hold_every_record_once(paths, records, share):
    assert names({"paths": paths[0], "share": str(share)}) == [r["qname"] for r in records]


@pytest.mark.parametrize("regions", [[("c1", 1_000_000, 1_000_001)], [("c1", 0, 3_000_000)], [("c2", 16_384, 32_768), ("c1", 2_000_000, 2_100_000), ("c2", 20_000, 40_000)], [("empty", 0, 1000)], [("none", 0, 10)], [("c1", 50, 50)], []])
def test_regions_equal_a_plain_filter(paths, records, regions):
    expected = overlapping(records, [r for r in regions if r[1] < r[2]])
    text = bam.json.dumps(regions)
    assert names({"paths": paths[1], "regions": text}) == expected
    for share in (20_000, 1 << 30):
        assert names({"paths": paths[0], "regions": text, "share": str(share)}) == expected


def test_a_region_reads_its_own_blocks(paths, monkeypatch):
    inflated = set()
    plain = bam._inflate

    def counted(stream, at=0, block_size=1 << 20):
        for member, piece in plain(stream, at, block_size):
            inflated.add(member)
            yield member, piece

    monkeypatch.setattr(bam, "_inflate", counted)
    names({"paths": paths[1], "chrom": "c2", "start": "100000", "end": "100500"})
    whole = len(inflated)
    inflated.clear()
    assert names({"paths": paths[0], "chrom": "c2", "start": "100000", "end": "100500"})
    assert whole > 40 and len(inflated) <= 8


PUSHED = [
    ("rname = 'c2' AND pos0 < 30000", lambda r: r["rname"] == "c2" and r["pos0"] < 30_000),
    ("rname IN ('c1', 'none') AND pos0 >= 2900000 AND mapq >= 60", lambda r: r["rname"] == "c1" and r["pos0"] >= 2_900_000),
    ("rname = 'c1' AND end0 > 100000 AND pos0 <= 100100", lambda r: r["rname"] == "c1" and r["pos0"] <= 100_100 and r["pos0"] + max(sum(c["len"] for c in r["cigar"]), 1) > 100_000),
    ("flag = 4", lambda r: r["flag"] == 4), ("rname IS NULL", lambda r: r["rname"] is None), ("rname = 'c1' AND rname = 'c2'", lambda r: False), ("mapq < 60", lambda r: False),
    ("qname LIKE 'c2_1%' AND rname = 'c2'", lambda r: r["qname"].startswith("c2_1")), ("sample = 'other'", lambda r: False),
]


@pytest.mark.parametrize("condition, plain", PUSHED)
def test_pushed_filters_change_no_result(spark, paths, records, condition, plain):
    for path in paths:
        got = bam.alignments(spark, [path]).where(condition)
        assert sorted(r.qname for r in got.select("qname").collect()) == sorted(r["qname"] for r in records if plain(r))


def read_bytes(monkeypatch, options, filters=()):
    """(names, compressed bytes read) of a scan in this process."""
    seen = [0]
    plain = bam._stream

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n=-1):
            out = self.f.read() if n < 0 else self.f.read(n)
            seen[0] += len(out)
            return out

        def seek(self, at):
            self.f.seek(at)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    with monkeypatch.context() as m:
        m.setattr(bam, "_stream", lambda path: plain(path) if path.endswith(".bai") else Counted(plain(path)))
        reader = bam.BamReader(options)
        assert list(reader.pushFilters(list(filters))) == []
        return [n for part in reader.partitions() for batch in reader.read(part) for n in batch.column("qname").to_pylist()], seen[0]


def test_runs_read_their_blocks_and_the_tail(paths, records, monkeypatch):
    import os

    from pyspark.sql.datasource import EqualTo, LessThan

    whole = os.path.getsize(paths[0])
    got, n = read_bytes(monkeypatch, {"paths": paths[0]}, [EqualTo(("rname",), "c2"), LessThan(("pos0",), 2000)])
    assert got == overlapping(records, [("c2", 0, 2000)]) and n < whole / 2
    lost = [r["qname"] for r in records if r["flag"] & 4]
    got, n = read_bytes(monkeypatch, {"paths": paths[0], "unmapped": "true"})
    assert got == lost and n < whole / 2  # no contig holds any, as the index says
    assert read_bytes(monkeypatch, {"paths": paths[1], "unmapped": "true"})[0] == lost
    assert read_bytes(monkeypatch, {"paths": ",".join(paths)}, [EqualTo(("sample",), "t")]) == ([], 0)


def test_unmapped_records_with_a_place(tmp_path, records):
    """Unmapped mates stand beside their partners: their contig is searched, others are not."""
    rows = [dict(r, flag=4) if k == 3000 else r for k, r in enumerate(records)]
    path = f"{tmp_path}/p.bam"
    bam.write_bam(path, CONTIGS, rows)
    bam.write_index(path)
    assert bam.Index.read(path + ".bai").unmapped == [1, 0, 0]
    for share in (20_000, 1 << 30):
        assert names({"paths": path, "unmapped": "true", "share": str(share)}) == [r["qname"] for r in rows if r["flag"] & 4]


def test_spark_reads_indexed_files(spark, paths, records):
    regions = [("c1", 500_000, 700_000), ("c2", 10, 2000)]
    got = bam.alignments(spark, paths, regions=regions).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in got} == dict.fromkeys(paths, len(overlapping(records, regions)))


def test_an_unsorted_file_gets_no_index(tmp_path, records):
    path = f"{tmp_path}/u.bam"
    bam.write_bam(path, CONTIGS, records[::-1])
    with pytest.raises(ValueError, match="not sorted"):
        bam.write_index(path)


def test_a_file_without_records(tmp_path):
    path = f"{tmp_path}/none.bam"
    bam.write_bam(path, CONTIGS, [])
    assert names({"paths": path}) == []
    bam.write_index(path)
    assert names({"paths": path}) == [] and names({"paths": path, "chrom": "c1"}) == []
