import io
import random

import pytest

from seqtally.llm.warc import archived_pages, member, page_record, payload_of, read_archives, salvage, sha1_base32


def records(n=40):
    rnd = random.Random(2)
    for i in range(n):
        body = (b"x%d<p>hello \x1f\x8b\x08</p>" % i) * rnd.randint(0, 2000)
        yield page_record(str(i), f"http://a/{i}\r\nX: y", body, sha1_base32(body), None)


@pytest.mark.parametrize("pack", [member, bytes])
def test_salvage_recovers_what_follows_damage(pack):
    parts = [pack(r) for r in records()]
    off = [0]
    for p in parts:
        off.append(off[-1] + len(p))
    whole = list(salvage(io.BytesIO(b"".join(parts))))
    assert len(whole) == 40 and not any(r.reason for r in whole)
    bad = bytearray(b"".join(parts))
    bad[off[10] + len(parts[10]) // 2] ^= 0x55
    bad[off[20]] = 0
    bad = bytes(bad[: off[30]]) + b"junk" * 500_000 + bytes(bad[off[30] : off[39] + 30])
    got = list(salvage(io.BytesIO(bad)))
    assert [int(r.headers["warc-record-id"][10:-1]) for r in got if not r.reason] == [i for i in range(39) if i not in (10, 20)]
    gaps = [(r.offset, r.length) for r in got if r.reason]
    assert gaps == [(off[10], len(parts[10])), (off[20], len(parts[20])), (off[30], 2_000_000), (off[39] + 2_000_000, 30)]
    assert sum(r.length for r in got) == len(bad)


def test_nothing_but_damage():
    assert list(salvage(io.BytesIO(b""))) == []
    (gap,) = salvage(io.BytesIO(b"\x1f\x8b\x08" + b"z" * 100))
    assert (gap.offset, gap.length) == (0, 103) and gap.reason
    (gap,) = salvage(io.BytesIO(b"WARC/1.0\r\nContent-Length: 99999999\r\n\r\nshort"))
    assert gap.reason == "record is cut short"


def test_round_trip(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "same"), (4, "u\r\nx", None), (5, "u", ""), (6, "u", "é\U0001f600" * 100_000)]
    rows += [(7, "http://a/7", "tie"), (7, "http://a/7", "tie"), (None, "u", "only"), (8, "u", "<p>a\r\n\r\nWARC/1.1\r\n</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as digest", "1 as first", "'c' as payload", "'c' as n")
    got = sorted(map(tuple, archived_pages(spark, pages).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None), default=None)
        other = top is not None and top != i
        want.append((i, len(raw), sha1_base32(raw), "revisit" if other else "response", top if other else None))
    assert got == sorted(want, key=str)
    assert archived_pages(spark, pages.where("false")).count() == 0


def test_reader_lists_gaps_and_payloads(spark, tmp_path):
    body = b"<p>kept</p>"
    good = member(page_record("1", "http://a/", body, sha1_base32(body), None))
    path = tmp_path / "damaged.warc.gz"
    path.write_bytes(good + b"???" + good)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{p}",) for p in tmp_path.iterdir()], "file string")
    rows = sorted(read_archives(files).collect(), key=lambda r: r.offset)
    assert [r.type for r in rows] == ["response", None, "response"]
    assert bytes(rows[0].payload) == body and rows[1].length == 3 and rows[1].gap_reason
    assert payload_of(b"plain") == b"plain"


def test_a_member_may_hold_several_records():
    parts = list(records(6))
    got = list(salvage(io.BytesIO(member(b"".join(parts[:5])) + member(parts[5]))))
    assert [r.headers["warc-record-id"][10:-1] for r in got] == [str(i) for i in range(6)]
    assert [r.offset for r in got[:5]] == [0] * 5 and sum(r.length for r in got) == len(member(b"".join(parts[:5])) + member(parts[5]))
    torn = parts[1].replace(b"Content-Length: ", b"Content-Length: 1", 1)
    got = list(salvage(io.BytesIO(member(b"".join([parts[0], torn, *parts[2:5]])))))
    assert [r.headers["warc-record-id"][10:-1] for r in got if not r.reason] == ["0", "2", "3", "4"]
    assert [r.reason.startswith(f"{len(torn)} bytes") for r in got if r.reason] == [True]


def test_a_lost_record_is_an_error(spark, tmp_path):
    data = b"".join(member(r) for r in records(3))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    files = lambda n: spark.createDataFrame([(str(path), n)], "file string, n_records long")
    assert read_archives(files(3)).count() == 3 and read_archives(files(None)).count() == 3
    with pytest.raises(Exception, match="3 of the 4 records"):
        read_archives(files(4)).collect()
