"""Units packed by size, read once, finished ones skipped on a re-run."""

import gzip
import os
import tempfile

import pytest

from clonalyze.sources import files as S
from clonalyze.sources import ingest as I

HEADER = ",".join("sequence_alignment_aa" if i == 14 else f"f{i}" for i in range(1, 48))


def _unit(path, n, first=0):
    with gzip.open(path, "wt") as f:
        f.write('"{""Run"": ""X""}"\n' + HEADER + "\n")
        for i in range(n):
            row = [""] * 47
            row[13], row[34], row[36], row[40], row[44], row[46] = f"QVQ{'ACDEFGHIKL'[(first + i) % 10] * (1 + i % 50)}", "A" * 25, "GFTFSS", "ISGSGG", "W" * 11, "ARDYWG"
            f.write(",".join(row) + "\n")


def _scratch():
    return tempfile.mkdtemp(prefix="clonalyze-test-", dir="/tmp")


def test_longest_first_packing_is_even_and_whole():
    sizes = [(f"u{i}", 1 + 97 * i * i % 1009) for i in range(200)] + [("big", 9000)]
    bins = I.pack(sizes, 8)
    held = [sum(dict(sizes)[u] for u in b) for b in bins]
    assert sorted(u for b in bins for u in b) == sorted(u for u, _ in sizes)
    assert max(held) <= 1.2 * min(held)
    assert I.pack([("a", 3)], 8) == [["a"]] and I.pack([], 8) == []


def test_waves_hold_every_unit_and_keep_the_bound():
    sizes = [(f"u{i:02}", 10 + i) for i in range(20)] + [("v", 500)]
    w = list(I.waves(sizes, 100))
    assert sorted(u for x in w for u in x) == sorted(sizes)
    assert all(len(x) == 1 or sum(s for _, s in x) <= 100 for x in w)


def test_rows_equal_the_plain_reader_and_no_unit_is_lost(spark):
    d = _scratch()
    for i in range(7):
        _unit(f"{d}/u{i}.csv.gz", 40 * i * i, i)            # u0 has no rows
    rows = I.ingest_units(spark, [f"{d}/*.csv.gz"], f"{d}/out", tasks=3)
    plain = S.ingest_oas(spark, [f"{d}/*.csv.gz"])
    assert sorted(r.sequence_alignment_aa for r in rows.collect()) == sorted(r.sequence_alignment_aa for r in plain.collect())
    assert rows.select("seq_id").distinct().count() == rows.count() > 0
    led = {os.path.basename(r.unit): r for r in I.ledger(spark, f"{d}/out").collect()}
    assert len(led) == 7 and led["u0.csv.gz"].kept == 0 and led["u3.csv.gz"].kept == 360 and {r.task for r in led.values()} == {0, 1, 2}


def test_a_stopped_run_goes_on_with_the_rest(spark):
    d = _scratch()
    for n in "abc":
        _unit(f"{d}/{n}.csv.gz", 60, ord(n))
    whole = open(f"{d}/c.csv.gz", "rb").read()
    with open(f"{d}/c.csv.gz", "wb") as f:
        f.write(whole[:len(whole) // 2])                    # cut off: fails its wave
    out = f"{d}/out"
    with pytest.raises(Exception):
        I.ingest_units(spark, [f"{d}/*.csv.gz"], out, wave_bytes=1)
    assert sorted(os.path.basename(r.unit) for r in I.ledger(spark, out).collect()) == ["a.csv.gz", "b.csv.gz"]
    assert I.finished(spark, out).count() == 120
    with open(f"{d}/c.csv.gz", "wb") as f:
        f.write(whole)
    with open(f"{d}/a.csv.gz", "wb") as f:
        f.write(b"not read again")
    again = I.ingest_units(spark, [f"{d}/*.csv.gz"], out, wave_bytes=1)
    assert again.count() == 180 and I.ledger(spark, out).count() == 3
    assert I.ingest_units(spark, [f"{d}/*.csv.gz"], out).count() == 180 and I.ledger(spark, out).count() == 3


def test_ids_survive_another_folder_and_packing_and_short_rows_are_null(spark):
    d, e = _scratch(), _scratch()
    for folder in (d, e):
        _unit(f"{folder}/u1.csv.gz", 30)
        _unit(f"{folder}/u2.csv.gz", 30)                    # same rows under another name: ids of their own
    one = {r.seq_id for r in I.ingest_units(spark, [f"{d}/*.csv.gz"], f"{d}/out", tasks=1).collect()}
    assert one == {r.seq_id for r in I.ingest_units(spark, [f"{e}/*.csv.gz"], f"{e}/out", tasks=2, wave_bytes=1).collect()} and len(one) == 60
    with open(f"{d}/s.csv", "w") as f:
        f.write('"{""Run"": 1}"\n' + HEADER + "\nx,y\n\n" + ",".join(["q"] * 13 + ['"A,""B"']) + "\n")
    got = list(I.unit_rows(f"file:{d}/s.csv"))
    assert [(r[1], r[2], r[3]) for r in got] == [(3, None, None), (5, 'A,"B', None)]
    assert I.finished(spark, f"{d}/nothing").count() == 0
