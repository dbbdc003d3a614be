"""Very long tokens, and archives that are cut off or altered."""

import base64
import gzip
import random
from time import process_time

import pytest

from lattica.llm import secret_scan, warc_fixity


def test_long_tokens_take_linear_time():
    blob = base64.b64encode(random.Random(3).randbytes(1_500_000)).decode().replace("/", "A")
    for text in (blob, "example" * 200_000, "password=x9" * 100_000, ("ab0/" * 5 + "Qx7Zk2") * 60_000):
        began = process_time()
        spans = secret_scan.all_spans(text)
        assert process_time() - began < 15
    assert secret_scan.all_spans(blob) == [(0, 3, len(blob))] and spans == []


def record(i, body=b"body"):
    return b"WARC/1.0\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Target-URI: u%d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, i, len(body), body)


def ranges(members):
    at = [0]
    for m in members:
        at.append(at[-1] + len(m))
    return list(zip(at, at[1:]))


@pytest.mark.parametrize("zipped", [True, False])
def test_damage_is_located(spark, tmp_path, zipped):
    pack = gzip.compress if zipped else bytes
    members = [pack(record(i, random.Random(i).randbytes(300))) for i in range(6)]
    where = ranges(members)
    whole = b"".join(members)
    cut = whole[:-9]
    flipped = bytearray(whole)
    for k in range(*where[2]):
        flipped[k] ^= 0xFF
    for name, content in (("whole", whole), ("cut", cut), ("flipped", bytes(flipped)), ("noise", b"\x1f\x8b\x08 no gzip"), ("empty", b"")):
        (tmp_path / f"{name}.warc").write_bytes(content)
    got = {}
    for r in warc_fixity.read_warc(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[1].removesuffix(".warc"), []).append((r.start, r.end, r.damaged))
    assert sorted(got["whole"]) == [(a, b, False) for a, b in where]
    assert sorted(got["cut"]) == [(a, b, False) for a, b in where[:5]] + [(where[5][0], len(cut), True)]
    if zipped:
        assert sorted(got["flipped"]) == [(a, b, i == 2) for i, (a, b) in enumerate(where)]
    else:
        assert {(a, b) for a, b, bad in got["flipped"] if not bad} == {where[i] for i in (0, 1, 3, 4, 5)}
    assert got["noise"] == [(0, 11, True)] and "empty" not in got


def test_members_with_several_records():
    one = gzip.compress(record(1) + record(2))
    two = gzip.compress(record(3))
    assert [(a, b, h and h["warc-target-uri"]) for a, b, h, _ in warc_fixity.split_records(one + two)] == [(0, len(one), "u1"), (0, len(one), "u2"), (len(one), len(one) + len(two), "u3")]
