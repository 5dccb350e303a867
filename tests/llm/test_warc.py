import base64
import hashlib

from voxelyard.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, offset string, archive int")


def brute(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault((r[2] or "").encode(), []).append(i)
    out = []
    for payload, members in groups.items():
        ids = [rows[i][0] for i in members]
        first = min((x for x in ids if x is not None), default=None)
        taken = False
        for x in ids:
            response = x == first and not taken
            taken |= response
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out.append((x, len(payload), digest, "response" if response else "revisit", None if response else first))
    return sorted(map(str, out))


def test_round_trip_with_edges(spark):
    big = "<p>" + "long text " * 100_000
    rows = [
        (1, "http://a.example.com/x", "<p>same</p>", None, 1), (2, "http://b.example.com/x?y", "<p>same</p>", None, 1), (2, "http://b.example.com/x?y", "<p>same</p>", None, 1),
        (3, None, None, None, None), (4, "no scheme", "", None, 1), (5, "https://A.example.com", big, "z", 1), (6, "http://a.example.com/x", "café \U0001f600\r\n\r\n", None, 1),
        (7, "http://h.example.com/\né", "x", None, 1), (None, "http://n.example.com/", "null id", None, 1), (9, "", "\x00\x01", None, 1),
    ]
    got = warc.round_trip(pages(spark, rows), with_payload=True).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(rows)
    held = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert held[5] == big and held[6] == rows[6][2]
    assert sorted(str(r.url) for r in got) == sorted(str(r[1]) for r in rows)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_hot_key_spans_blocks(spark):
    rows = [(i, "http://hot.example.com/" if i % 3 else f"http://c{i}.example.com/{i}", f"p{i}", None, 1) for i in range(300)]
    captures = warc.write_archives(pages(spark, rows))
    shards = warc.build_index(captures, block_lines=7)
    key = spark.createDataFrame([("com,example,hot)/",), (None,), ("com,example,absent)/",)], "surt string")
    found = warc.lookup(shards, key)
    assert sorted(r.page_id for r in found.collect()) == [i for i in range(300) if i % 3]
    assert warc.read_records(found).count() == 200


def test_blocks_of_a_key():
    directory = ["a", "c", "c", "e"]
    assert list(warc.candidate_blocks(directory, "c")) == [0, 1, 2]
    assert list(warc.candidate_blocks(directory, "b")) == [0]
    assert list(warc.candidate_blocks(directory, "z")) == [3]


def test_small_payloads_stay_responses(spark):
    rows = [(1, "http://a.b/", "x", None, 1), (2, "http://a.c/", "x", None, 1)]
    assert {r.record_type for r in warc.write_archives(pages(spark, rows), min_payload=2).collect()} == {"response"}


def test_archives_are_plain_warc(spark):
    import glob
    import gzip

    rows = [(1, "http://a.b/\u00e9 x\ny", "same", None, 1), (2, None, "same", None, 1), (2, None, "same", None, 1), (3, "no scheme", "own", None, 1)]
    captures = warc.write_archives(pages(spark, rows)).collect()
    ids, told = [], []
    for name in {c.archive for c in captures}:
        raw = gzip.open(glob.glob(name.removeprefix("file://"))[0]).read()
        kinds = []
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = head.decode("ascii").split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert lines[0] == "WARC/1.1" and rest[int(fields["Content-Length"]) :][:4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"]), ids.append(fields["WARC-Record-ID"])
            told += [fields["WARC-Refers-To"]] if "WARC-Refers-To" in fields else []
            if kinds[-1] != "warcinfo":
                assert ":" in fields["WARC-Target-URI"] and not set(" \n") & set(fields["WARC-Target-URI"])
            raw = rest[int(fields["Content-Length"]) + 4 :]
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
    assert len(ids) == len(set(ids)) and len(told) == 2 and set(told) <= set(ids)


def test_one_response_among_repeated_rows(spark):
    rows = [(i % 3, f"http://a.b/{i % 2}", "same", None, 1) for i in range(60)]
    got = warc.round_trip(pages(spark, rows).repartition(7)).collect()
    assert sorted(r.record_type for r in got) == ["response", *["revisit"] * 59]
    assert {r.page_id for r in got if r.record_type == "response"} == {0} and {r.refers_to for r in got if r.record_type == "revisit"} == {0}
