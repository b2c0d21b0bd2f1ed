import gzip
import hashlib
import io

import pytest

from strandlake.llm.warc import inflated, normalise, parsed, read_member, record, records, round_trip, write_archives

BIG = "<p>" + "x" * 2000
PAGES = [
    (1, "http://a/", BIG), (2, "http://b/\r\nx", BIG), (9, None, BIG), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", BIG), (None, "u", "only here" * 200),
    (10, "u", "é" * 499 + "a"), (11, "u", "é" * 499 + "a"), (12, "u", "é" * 500), (13, "u", "é" * 500), (14, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 90), (15, "u", "y" * 300_000), (16, "u", BIG + "!"), (16, "u", BIG + "!"),
]


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "last": F.lit(2), "size": F.lit(3)})


def plain():
    out, last = [], {}
    for p, _, h in PAGES:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            last[b] = max(last.get(b, p), p)
    for p, _, h in PAGES:
        b = (h or "").encode()
        ref = last.get(b) if len(b) >= 1000 else None
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if ref is not None and ref != p else "response", ref if ref != p else None))
    return sorted(out, key=lambda x: tuple((v is None, str(type(v)), v) for v in x))


def test_round_trip(pages):
    got = round_trip(pages.repartition(3)).collect()
    mine = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=lambda x: tuple((v is None, str(type(v)), v) for v in x))
    assert mine == plain()
    texts, names = {p: h or "" for p, _, h in PAGES}, {}
    members = [parsed(read_member(r.archive, r.offset, r.length)) for r in got]
    names = {f["WARC-Record-ID"]: r for r, f in zip(got, members)}
    assert len(names) == len(got)
    for r, f in zip(got, members):
        target = f.get("WARC-Refers-To")
        assert r.record_type == "revisit" or target is None
        assert target is None or (names[target].page_id, names[target].record_type, names[target].payload_digest) == (r.refers_to, "response", r.payload_digest)
        if r.record_type == "response" and r.page_id is not None:
            assert f["payload"] == texts[r.page_id].encode()
        if r.record_type == "revisit":
            assert f["payload"] == b""


def test_no_pages(pages):
    assert round_trip(pages.where("false")).collect() == []


def test_a_truncated_stream_fails(spark, pages, tmp_path):
    written = write_archives(pages.coalesce(1), f"file://{tmp_path}/w").collect()[0]
    path = written.path.removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data[: len(data) // 2])
    with pytest.raises(Exception):
        normalise(spark.createDataFrame([(written.path, written.records)], "path string, records long")).collect()


def test_inflating_one_member_or_many():
    recs = [record(i, "u", b"p" * i * 999, hashlib.sha1(b"p" * i * 999).hexdigest(), f"urn:page:{i}") for i in range(5)]
    for data in (gzip.compress(b"".join(recs)), b"".join(map(gzip.compress, recs))):
        assert list(records(inflated(io.BytesIO(data)))) == recs


def test_archives_stay_in_the_applications_folder_and_are_written_once(spark):
    import os

    from strandlake.llm.common import _run_dir, shared_dir
    from strandlake.llm.warc import round_trip

    def archives(top):
        return [f for d, _, names in os.walk(top) for f in names if ".warc.gz" in f]

    top, own = (x.removeprefix("file:").replace("//", "/") for x in (shared_dir(spark), _run_dir(spark)))
    before = len(archives(top))
    found = round_trip(spark.createDataFrame([(1, "u", "a" * 2000), (2, "v", "a" * 2000)], "page_id long, url string, html string"))
    assert found.count() == found.count() == 2
    assert len(archives(top)) == len(archives(own)) >= before + 3
    assert len(archives(top)) <= before + 6  # each archive, its members and their index, for one or two tasks, whatever reads the result
    assert not [d for d in os.listdir(top) if d.startswith("warc-")]
