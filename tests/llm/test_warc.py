"""Archives read back whole, by record and by frame."""

import hashlib
from collections import defaultdict
from pathlib import Path

import zstandard

from flowmill.llm import warc


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"p{i % 7} é" * (60 if i % 3 else 3)) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nX: y", ""), (None, "n", "p1 é" * 60), (7, "again", "p0 é" * 60), (200, "big", "z" * 700_000)]
    path = str(tmp_path / "bundles")
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, bundle int")
    warc.write_bundles(df.repartition(3), path, bundle_bytes=2000)
    payloads = [((h or "").encode(), i) for i, _, h in rows]
    first = defaultdict(list)
    for b, i in payloads:
        if len(b) >= 100 and i is not None:
            first[b].append(i)
    want = sorted((str(i) if i is not None else "none", len(b), hashlib.sha256(b).hexdigest(), *(
        ("revisit", str(min(first[b]))) if i is not None and len(b) >= 100 and min(first[b]) != i else ("response", None)))
        for b, i in payloads)
    got = warc.read_bundles(spark, path).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert {r.url for r in got if r.record_id == "101"} == {"u%0D%0AX: y"}
    files = sorted(Path(path).glob("bundle-*.warc.zst"))
    assert len(files) > 3
    for f in files:
        raw = f.read_bytes()
        sizes = warc.frames_of(raw)
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert len(whole) == sum(x[2] for x in sizes)  # a plain reader skips the footer
    for r in warc.read_index(spark, path).collect():
        headers, _ = warc.read_record((Path(path) / warc.bundle_name(r.bundle)).read_bytes(), r.frame, r.offset, r.length)
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.record_id}>"


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    Path(path).mkdir()
    warc.write_bundles(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_bundles(spark, path).count() == 0 and warc.read_index(spark, path).count() == 0
