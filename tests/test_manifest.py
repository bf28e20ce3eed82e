"""Streamed file digests and the manifests made from them."""

import hashlib
import json

import pytest

from flowintel.sources import digests, manifest


@pytest.fixture
def folder(tmp_path):
    for name, content in (("part-0.bin", b"data block A"), ("part-1.bin", b"data block B" * 1000), ("deep/_skipped", b"x"),
                          ("_kept/part-2.bin", b""), (".hidden", b"y"), ("deep/ü 3.gz", b"not compressed")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def entries(frame):
    return {r.path: (r.sha256, r.size_bytes) for r in frame.collect()}


def expected(folder, names):
    return {n: (hashlib.sha256((folder / n).read_bytes()).hexdigest(), (folder / n).stat().st_size) for n in names}


NAMES = ["part-0.bin", "part-1.bin", "_kept/part-2.bin", "deep/ü 3.gz"]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_entries_do_not_depend_on_the_chunk(spark, folder, chunk):
    for uri in (str(folder), f"file:{folder}", f"file://{folder}/"):
        assert entries(manifest.file_entries(spark, uri, chunk_bytes=chunk)) == expected(folder, NAMES)


def test_manifest_of_a_list_equals_that_of_the_folder(spark, folder):
    whole = manifest.manifest(manifest.file_entries(spark, str(folder))).first()
    files = [str(folder / n) for n in reversed(NAMES)]
    assert manifest.manifest(manifest.file_entries(spark, files, base=str(folder))).first() == whole
    assert whole.files_count == 4 and whole.total_bytes == sum(n for _, n in expected(folder, NAMES).values())
    (folder / "part-0.bin").write_bytes(b"data block a")
    assert manifest.manifest(manifest.file_entries(spark, str(folder))).first().source_manifest_hash != whole.source_manifest_hash


def test_names_of_lists(spark, folder, tmp_path_factory):
    other = tmp_path_factory.mktemp("other") / "far.bin"
    other.write_bytes(b"far")
    found = entries(manifest.file_entries(spark, [str(folder / "part-0.bin"), str(folder / "deep"), str(other), str(folder / ".hidden")]))
    assert set(found) == {"part-0.bin", "deep/ü 3.gz", "far.bin", ".hidden"}
    assert entries(manifest.file_entries(spark, str(folder / "part-0.bin"))).keys() == {"part-0.bin"}
    twice = manifest.file_entries(spark, [str(other), str(other)])
    assert twice.count() == 2 and twice.distinct().count() == 1
    with pytest.raises(Exception, match="nowhere"):
        manifest.file_entries(spark, [str(folder / "nowhere")]).collect()
    (folder / "void").mkdir()
    assert manifest.file_entries(spark, str(folder / "void")).count() == 0


def test_large_files_stand_alone_and_small_ones_share_a_task(folder):
    reader = digests.DigestReader({"paths": json.dumps([str(folder)]), "partition_bytes": "1000"})
    sizes = [[size for *_, size in part.files] for part in reader.partitions()]
    assert [12000] in [sorted(s)[-1:] for s in sizes] and all(sum(s) <= 1000 or len(s) == 1 for s in sizes)
    assert sum(map(len, sizes)) == 4


def test_a_file_above_two_gibibytes(spark, tmp_path):
    size = (2 << 30) + 5
    with open(tmp_path / "large.bin", "wb") as out:  # sparse: takes no disk
        out.seek(size - 5)
        out.write(b"tail!")
    digest, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2 << 10):
        digest.update(zeros)
    digest.update(b"tail!")
    assert entries(manifest.file_entries(spark, str(tmp_path))) == {"large.bin": (digest.hexdigest(), size)}
