"""WARC archives: exact round trip, answers and revisits, refusal of damaged archives."""

import base64
import glob
import hashlib
import random

import pytest
import zstandard

from telemetry_ops.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string, same long, answer string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1, "clash") for i, u, h in rows], SCHEMA)


def expected(rows):
    found = []
    for i, _, h in rows:
        body = (h or "").encode()
        ids = [r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None]
        top = max(ids, default=None)
        again = i != top
        found.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(found, key=repr)


def archive(records, dictionary=b"", **options):
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    engine = zstandard.ZstdCompressor(dict_data=given, **options)
    return (W.skippable(dictionary) if dictionary else b"") + b"".join(engine.compress(r) for r in records)


def record(k=1, body=b"<p>", **change):
    return W.make_record(k, f"http://a/{k}", body, change.get("answer"), change.get("revisit", False), "2024-01-01T00:00:00Z")


def test_pages_come_back(spark):
    rng = random.Random(1)
    rows = [(k, f"http://x/{k}", f"<p>{rng.random()}</p>" * 30) for k in range(60)]
    rows += [(100 + k, "http://copy", "<b>copy</b>") for k in range(25)]
    rows += [(200, None, None), (201, "http://e", ""), (None, "http://n", ""), (None, "u", "alone"), (None, "v", "alone"), (300, "a b\r\nX: y", "é" * 200_000)]
    rows += [(400, "r", "again"), (400, "r", "again"), (399, "r", "again")]  # a repeated id answers twice
    got = W.page_records(spark, pages(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_payloads_urls_and_small_archives(spark, tmp_path):
    rows = [(k, f"http://x/{k}?q=ü", "<html>" + "word " * 200 + str(k)) for k in range(40)]
    path = str(tmp_path / "warc")
    W.write_archives(pages(spark, rows).coalesce(1), path, archive_bytes=700)
    files = glob.glob(f"{path}/part*")
    assert len(files) > 2
    for f in files:
        data = open(f, "rb").read()
        first, *rest = list(W.frames(memoryview(data)))
        assert first[2] == W.DICTIONARY_FRAME and sum(1 for x in rest if x[2] == 0) >= 1
        with zstandard.ZstdDecompressor(dict_data=W.load_dictionary(data[8 : first[1]])).stream_reader(data, read_across_frames=True) as other:
            assert other.read().count(b"WARC/1.1\r\n") == sum(1 for x in rest if x[2] == 0)  # another reader agrees
    got = {r["record_id"]: r for r in W.read_archives(spark, path).collect()}
    assert len(got) == 40
    for k, url, html in rows:
        r = got[W.record_id(k, W.base32_sha1(html.encode()))]
        assert bytes(r["payload"]) == html.encode() and r["target_uri"] == url.replace("ü", "%C3%BC") and r["error"] is None


def test_least_bytes_and_empty_table(spark, tmp_path):
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")]
    W.write_archives(pages(spark, rows), str(tmp_path / "a"), least_bytes=5)
    kinds = {W.page_of(r["record_id"]): r["record_type"] for r in W.read_archives(spark, str(tmp_path / "a")).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert W.page_records(spark, pages(spark, [])).collect() == []


@pytest.mark.parametrize("compressed", [False, True])
def test_dictionary_of_leading_frame(compressed):
    records = [record(k, b"<html><body>" + str(k).encode() * 50) for k in range(300)]
    dictionary = zstandard.train_dictionary(2048, records).as_bytes()
    plain = archive(records, dictionary)
    head = W.skippable(zstandard.ZstdCompressor().compress(dictionary)) if compressed else W.skippable(dictionary)
    data = head + plain[len(W.skippable(dictionary)) :]
    assert [raw for _, raw in W.read_frames(memoryview(data))] == records
    with pytest.raises(W.Damaged, match="wants dictionary"):
        list(W.read_frames(memoryview(data[len(head) :])))


def test_other_frames_are_passed_over():
    data = W.skippable(b"note", 0x184D2A50) + archive([record()]) + W.EMPTY_FRAME.encode()
    data += zstandard.ZstdCompressor(write_content_size=False).compress(record(2)) + archive([record(3, b"")])
    assert [W.page_of(W.read_record(raw)["record_id"]) for _, raw in W.read_frames(memoryview(data))] == [1, 2, 3]


GOOD = record()
DAMAGED = {
    "version": GOOD.replace(b"WARC/1.1", b"WARC/9.9"),
    "no warc-date": GOOD.replace(b"WARC-Date:", b"Other:"),
    "length": GOOD.replace(b"<p>\r\n", b"<p>x\r\n"),
    "HTTP length": W.make_record(1, "u", b"<p>", None, False, "d").replace(b"Content-Length: 3", b"Content-Length: 4").replace(b"WARC-Block-Digest", b"Old-Digest"),
    "payload digest": GOOD.replace(b"<p>", b"<q>").replace(b"WARC-Block-Digest", b"Old-Digest"),
    "block digest": GOOD.replace(b"<p>", b"<q>"),
    "not a header line": GOOD.replace(b"WARC-Date:", b"WARC-Date"),
    "two records": GOOD + GOOD,
    "no end of headers": b"WARC/1.1\r\n",
}


@pytest.mark.parametrize("name", DAMAGED)
def test_damaged_records_are_refused(name):
    assert W.read_record(GOOD)["payload"] == b"<p>"
    with pytest.raises(W.Damaged, match=None if name in ("version", "two records") else name):
        W.read_record(DAMAGED[name])


def test_damaged_frames_are_refused():
    data = archive([record(), record(2)])
    for cut in range(1, len(data)):
        try:
            assert len(list(W.read_frames(memoryview(data[:cut])))) == 1  # only where a frame ends
            assert cut == len(archive([record()]))
        except W.Damaged:
            pass
    with pytest.raises(W.Damaged):
        list(W.read_frames(memoryview(W.skippable(b"x" * 9)[:-1])))
    with pytest.raises(W.Damaged, match="not a frame"):
        list(W.read_frames(memoryview(data + b"trailing bytes")))


def test_report_instead_of_failure(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive([record(), DAMAGED["length"], record(3)]))
    (tmp_path / "b.warc.zst").write_bytes(archive([record(4)]) + b"garbage!")
    got = W.read_archives(spark, str(tmp_path), strict=False, glob="*.zst").collect()
    assert sorted(W.page_of(r["record_id"]) for r in got if r["error"] is None) == [1, 3, 4]
    assert sum(r["error"] is not None for r in got) == 2
    with pytest.raises(Exception, match=r"a.warc.zst at \d+"):
        W.read_archives(spark, str(tmp_path / "a.warc.zst")).collect()
