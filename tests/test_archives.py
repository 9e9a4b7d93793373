import io
import tarfile

import pytest

from eventloom.sources import archives


def packed(path, members, mode="w:gz", format=tarfile.PAX_FORMAT):
    with tarfile.open(path, mode, format=format) as tar:
        folder = tarfile.TarInfo("logs")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


MEMBERS = [
    ("a.txt", b"one\ntwo\r\nthree"),
    ("empty.txt", b""),
    ("logs/" + "long" * 40 + ".txt", "é\n\nü\n".encode()),
    ("wide.txt", b"x" * 3_000_000 + b"\nend\n"),
    ("bytes.bin", bytes(range(256)) * 8),
]


def lines(data):
    parts = data.decode("utf-8", "replace").split("\n")
    return [p.removesuffix("\r") for p in (parts[:-1] if parts[-1] == "" else parts)]


def joined(rows):
    out = {}
    for r in sorted((r for r in rows if r.error is None), key=lambda r: (r.member, r.ord)):
        out.setdefault(r.member, {}).setdefault(r.ord, []).append(r.line)
    return {m: ["".join(parts) for _, parts in sorted(v.items())] for m, v in out.items()}


@pytest.mark.parametrize("name, mode, format", [("x.tar.gz", "w:gz", tarfile.PAX_FORMAT), ("x.tgz", "w:gz", tarfile.GNU_FORMAT), ("x.tar", "w", tarfile.PAX_FORMAT)])
def test_members(spark, tmp_path, name, mode, format):
    if name.endswith("tgz"):  # only names that end in .gz are decompressed
        name = "y.gz"
    packed(tmp_path / name, MEMBERS, mode, format)
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    got = joined(rows)
    assert {r.archive for r in rows} == {name} and not any(r.error for r in rows)
    assert {m: v for m, v in got.items() if m != "bytes.bin"} == {m: lines(d) for m, d in MEMBERS if d and m != "bytes.bin"}
    assert max(len(r.line) for r in rows) <= archives.PIECE


def test_a_plain_archive_in_splits(spark, tmp_path):
    packed(tmp_path / "x.tar", [(f"m{k}.txt", "".join(f"{k} {j}\n" for j in range(700)).encode()) for k in range(20)], "w")
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        rows = archives.read_archives(spark, str(tmp_path / "x.tar")).collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert joined(rows) == {f"m{k}.txt": [f"{k} {j}" for j in range(700)] for k in range(20)} and len(rows) == 14_000


def test_broken_archives_are_error_rows(spark, tmp_path):
    packed(tmp_path / "good.tar.gz", MEMBERS[:3])
    whole = (tmp_path / "good.tar.gz").read_bytes()
    packed(tmp_path / "cut.tar", [("a.txt", b"line\n" * 5000)], "w")
    (tmp_path / "cut.tar").write_bytes((tmp_path / "cut.tar").read_bytes()[:9000])
    (tmp_path / "none.tar.gz").write_bytes(b"")
    (tmp_path / "noise.tar.gz").write_bytes(b"this is no archive at all" * 99)
    packed(tmp_path / "half.tar.gz", [("r.txt", __import__("random").Random(1).randbytes(400_000).hex().encode())])
    (tmp_path / "half.tar.gz").write_bytes((tmp_path / "half.tar.gz").read_bytes()[:100_000])
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    assert {r.archive for r in rows if r.error} == {"cut.tar", "none.tar.gz", "noise.tar.gz", "half.tar.gz"} and whole
    assert joined([r for r in rows if r.archive == "good.tar.gz"])["a.txt"] == ["one", "two", "three"]
    assert sum(r.line == "line" for r in rows if r.archive == "cut.tar") > 1000
    assert all(sum(1 for r in rows if r.error and r.archive == a) == 1 for a in ("cut.tar", "none.tar.gz", "noise.tar.gz", "half.tar.gz"))


def test_written_archives_are_read_by_others(spark, tmp_path):
    rows = [(f"p{k % 2}.tar.gz", f"dir/m{k % 3}.txt", k, f"line {k}" * (k % 90)) for k in range(600)] + [("p9.tar.gz", "n" * 130 + ".txt", 1, "é")]
    archives.write_archives(spark.createDataFrame(rows, "archive string, member string, at long, value string").repartition(7), f"file://{tmp_path}/out", "at")
    for name in ("p0.tar.gz", "p1.tar.gz", "p9.tar.gz"):
        with tarfile.open(tmp_path / "out" / name) as tar:
            got = {m.name: tar.extractfile(m).read().decode() for m in tar}
        want = {}
        for a, m, _, v in rows:
            if a == name:
                want[m] = want.get(m, "") + v + "\n"
        assert got == want
