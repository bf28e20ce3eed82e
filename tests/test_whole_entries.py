"""Digests of files by a second way, which no size of a file stops."""

import hashlib

import pytest

import catalog
from catalog.views import TABLES
from flowintel.sources import manifest

catalog.load()


@pytest.fixture
def tables(tmp_path):
    """The tables' files: one beyond the size of a value, one in a folder of parts, the others small."""
    for name in TABLES:
        (tmp_path / f"{name}.parquet").write_bytes(name.encode() * 3)
    (tmp_path / "orders.parquet").unlink()
    (tmp_path / "orders.parquet").mkdir()
    for part in range(2):
        (tmp_path / "orders.parquet" / f"part {part}.parquet").write_bytes(b"part %d" % part)
    with open(tmp_path / "lineitem.parquet", "wb") as out:  # sparse: takes no disk
        out.seek((2 << 30) + 7)
        out.write(b"tail")
    return tmp_path


def test_table_manifest_of_a_file_above_two_gibibytes(spark, tables):
    found = {r.path: (r.same_digest, r.same_size, r.same_manifest) for r in catalog.QUERIES["table_manifest"](spark, str(tables)).collect()}
    names = {f"{t}.parquet" for t in TABLES} - {"orders.parquet"} | {f"orders.parquet/part {i}.parquet" for i in range(2)}
    assert found == dict.fromkeys(names, (True, True, True))


@pytest.mark.parametrize("bound", [0, 5, 6, 100])
def test_both_ways_give_the_same_entries(spark, tmp_path, bound):
    for name, content in (("a", b""), ("b", b"12345"), ("c", b"123456"), ("ü d", b"1234567")):
        (tmp_path / name).write_bytes(content)
    wanted = {p.name: (hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_size) for p in tmp_path.iterdir()}
    for folder in (str(tmp_path), f"file:{tmp_path}/"):
        found = manifest.whole_entries(spark, folder, bound).collect()
        assert len(found) == 4 and {r.path: (r.sha256, r.size_bytes) for r in found} == wanted
