"""Long files are read in pieces and judged like whole ones."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sentrilake.operators import triage
from sentrilake.sources import binaries
from tests.test_triage import pe


def _files():
    rng = random.Random(1)
    noise = rng.randbytes(40_000)
    lines = b"".join(rng.randbytes(rng.randrange(300)).replace(b"\n", b"") + b"\n" for _ in range(300))
    elf = b"\x7fELF\x02\x01\x01" + bytes(9) + bytes.fromhex("03003E0001000000") + bytes(60) + noise
    return {
        "noise": noise, "lines": lines, "open": lines + b"tail", "mark": b"\xef\xbb\xbf" + lines, "mark_open": b"\xef\xbb\xbf" + lines + b"x",
        "elf": elf, "macho": bytes.fromhex("CFFAEDFE07000001030000000200000010000000") + bytes(20) + noise,
        "zeros": bytes(50_000), "words": b"ab " * 20_000, "one_run": b"a" * 50_000, "run_inside": lines + b"b" * 30_000 + lines,
        "head_run": b"\x7fELF" + b"c" * 20_000 + lines, "pe": pe([(b".text", noise[:2000], 0x60000020)]) + noise, "packed.gz": b"no gzip\n" * 5000, "a b%20c": lines,
        "feeds": b"\n" * 30_000, "small": b"x",
    }


def test_long_files_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binaries, "PIECE_BYTES", 8192)
    files = _files()
    (tmp_path / "below").mkdir()
    for i, (name, data) in enumerate(files.items()):
        (tmp_path / ("below" if i % 2 else "") / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        pieces = binaries.read_binaries(spark, str(tmp_path), whole_up_to=1000).cache()
        given = {r.path.rsplit("/", 1)[1]: r for r in pieces.collect()}
        assert given.keys() == files.keys()
        whole = {name for name, r in given.items() if r.content is not None}
        assert whole == {"one_run", "run_inside", "head_run", "pe", "packed.gz", "small"}
        for name, r in given.items():
            data = files[name]
            assert r.length == len(data)
            if name in whole:
                assert bytes(r.content) == data and r.counts is None
            else:
                assert bytes(r.head) == data[:64] and r.counts == [data.count(bytes([b])) for b in range(256)], name
        columns = lambda df: {tuple(r) for r in df.withColumn("entropy", F.round("entropy", 9)).collect()}
        assert columns(triage.binary_triage(pieces)) == columns(triage.binary_triage(binaries.read_binaries(spark, str(tmp_path))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
