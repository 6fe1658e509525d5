import hashlib
import random

from spanweave.llm import warc


def records(n=20, seed=1):
    rng = random.Random(seed)
    return [warc.record(i, f"http://x/{i}", "".join(rng.choice("ab<>é\r\n") for _ in range(rng.randrange(3000))).encode(), None) for i in range(n)]


def ids(rows):
    return [r["record_id"] for r in rows if r["problem"] is None]


def test_sound_archives_have_no_gap():
    raw = records()
    for data in (b"".join(map(warc.member, raw)), b"".join(raw), warc.member(b"".join(raw)), raw[0] + warc.member(raw[1]) + raw[2]):
        rows = list(warc.salvage(data))
        assert all(r["problem"] is None for r in rows) and ids(rows) == [f"<urn:page:{i}>" for i in range(len(ids(rows)))]
    assert list(warc.salvage(b"")) == []


def test_damage_costs_only_what_it_hits():
    for wrap in (warc.member, bytes):
        rng = random.Random(7)
        for trial in range(60):
            parts = [wrap(r) for r in records(8, trial)]
            k = rng.randrange(8)
            broken, data = bytearray(parts[k]), b""
            how = rng.randrange(3)
            if how == 0:
                broken[rng.randrange(len(broken) // 2, len(broken) - 6)] ^= 0x55
            elif how == 1:
                broken = broken[: len(broken) // 2]
            else:
                broken = bytearray(rng.randbytes(50)) + broken
            data = b"".join(bytes(broken) if i == k else p for i, p in enumerate(parts))
            rows = list(warc.salvage(data))
            got, gaps = set(ids(rows)), [r for r in rows if r["problem"]]
            assert got >= {f"<urn:page:{i}>" for i in range(8) if i != k}
            if how == 1:
                assert gaps
            # ranges of records and gaps cover the archive without overlap
            spans = sorted({(r["start"], r["stop"]) for r in rows})
            assert spans[0][0] == 0 and spans[-1][1] == len(data)
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_round_trip_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "é\r\n\r\nWARC/1.1\r\n", *("x" * rng.randrange(5000) for _ in range(6))]
    rows = [(i, f"http://x/{i} y", rng.choice(texts)) for i in range(120)]
    first = {}
    for i, _, t in rows:
        first.setdefault((t or "").encode(), i)
    want = sorted((i, len(p), warc.base32_sha1(p), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, _, t in rows for p in [(t or "").encode()])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=lambda r: r[0]) == want
    none = {r.record_type for r in warc.round_trip(df, min_revisit=10_000).collect()}
    assert none == {"response"}


def test_reader_logs_gaps(spark, tmp_path):
    raw = [warc.member(r) for r in records(5)]
    (tmp_path / "a.warc.gz").write_bytes(raw[0] + b"junk" + raw[1] + raw[2][:40] + raw[3])
    found = warc.read_archives(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string"))
    assert [r.record_id for r in found.where("problem is null").orderBy("start").collect()] == [f"<urn:page:{i}>" for i in (0, 1, 3)]
    log = warc.gaps(found).orderBy("start").collect()
    assert [(r.start, r.stop) for r in log] == [(len(raw[0]), len(raw[0]) + 4), (len(raw[0]) + 4 + len(raw[1]), len(raw[0]) + 44 + len(raw[1]))]
    one = found.where("record_id = '<urn:page:3>'").first()
    assert warc.base32_sha1(bytes(one.payload)) == one.payload_digest and hashlib.sha1(one.payload).digest()


def test_damage_inside_a_member_costs_only_what_it_hits():
    rng = random.Random(11)
    name = "<urn:page:{}>".format
    for trial in range(20):
        raw = records(12, trial)
        k = rng.randrange(12)
        # one record is damaged before the archive is compressed as one member
        broken = bytearray(raw[k])
        broken[rng.randrange(len(broken) - 300, len(broken) - 6)] ^= 0x55
        one = warc.member(b"".join(bytes(broken) if i == k else r for i, r in enumerate(raw)))
        rows = list(warc.salvage(one + warc.member(raw[0])))
        assert ids(rows) == [name(i) for i in range(12) if i != k] + [name(0)]
        before = sum(map(len, raw[:k]))
        assert [r["problem"].partition(", ")[2] for r in rows if r["problem"]] == [f"bytes {before} to {before + len(raw[k])} of the member's content"]
        # the member itself is cut or has a bad byte; a sound one follows
        one = warc.member(b"".join(raw))
        at = rng.randrange(len(one) // 3, len(one) - 9)
        for bad in (one[:at], one[:at] + bytes([one[at] ^ 0x55]) + one[at + 1 :]):
            z = warc.zlib.decompressobj(31)
            whole = len(z.decompress(one[: at - 600])) if at > 600 else 0
            safe = [i for i in range(12) if sum(map(len, raw[: i + 1])) <= whole]
            rows = list(warc.salvage(b"junk" + bad + warc.member(warc.record(99, "http://x/99", b"z", None))))
            assert set(ids(rows)) >= {name(i) for i in safe} | {name(99)} and len(ids(rows)) == len(set(ids(rows)))
            assert any(r["problem"] for r in rows)
            spans = sorted({(r["start"], r["stop"]) for r in rows})
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_stored_records_of_a_damaged_member_are_read_once():
    raw = records(5)
    z = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    one = z.compress(b"".join(raw)) + z.flush()
    assert ids(warc.salvage(one[:-8] + b"\0" * 8)) == [f"<urn:page:{i}>" for i in range(5)]


def test_member_cut_after_its_last_record():
    for n in range(1, 14):
        rows = list(warc.salvage(warc.member(records(1)[0])[:-n] + warc.member(warc.record(99, "http://x/99", b"z", None))))
        assert ids(rows)[-1] == "<urn:page:99>" and (n > 9 or len(ids(rows)) == 2)


def test_archives_are_read_in_blocks(monkeypatch):
    for block in (64, 1000):
        monkeypatch.setattr(warc, "BLOCK", block)
        raw = records(6, 3)
        for data in (b"".join(raw), b"".join(map(warc.member, raw)), warc.member(raw[0]) + b"x" * 500 + raw[1] + raw[2][:-9] + raw[3] + warc.member(b"".join(raw[4:]))):
            monkeypatch.setattr(warc, "BLOCK", 1 << 20)
            want = list(warc.salvage(data))
            monkeypatch.setattr(warc, "BLOCK", max(block, max(map(len, raw))))
            assert list(warc.salvage(data)) == want and want
    a = warc.Archive(b"0123456789" * 50)
    assert a.part(3, 6) == b"345" and a.part(498, 600) == b"89" and a.part(0, 2) == b"01" and a.part(700, 800) == b""


def test_a_wrong_length_is_not_read(monkeypatch):
    raw = records(3, 4)
    broken = raw[1].replace(b"Content-Length: ", b"Content-Length: 9999999", 2)
    assert ids(warc.salvage(raw[0] + broken + raw[2])) == ["<urn:page:0>", "<urn:page:2>"]
