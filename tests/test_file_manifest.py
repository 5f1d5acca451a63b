"""Sizes and digests of files that are read in byte ranges and digested in rounds."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from evenmatch.sources.digests import Sha256
from evenmatch.sources.readers import file_manifest

SEED = random.Random(7)
RANDOM = SEED.randbytes(300_000)
MARK = b"\xef\xbb\xbf"
FILES = {
    "random.bin": RANDOM,
    "ends with a line feed.txt": RANDOM + b"\n",
    "mark.txt": MARK + RANDOM,
    "mark and feed.txt": MARK + b"\n" + RANDOM + b"\n\n",
    "crlf.txt": b"a\r\nb\rc\n" * 40_000,
    "feeds.bin": b"\n" * 100_003,
    "no feeds.bin": b"\0" * 200_000,
    "one block.bin": SEED.randbytes(50_001 - 1).replace(b"\n", b" ") + b"\n",
    "small.txt": b"small\n",
    "packed.gz": gzip.compress(RANDOM),
    "deep/down[1] %20é.bin": RANDOM[::-1],
    "_hidden.txt": b"hidden" * 50_000,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "deep").mkdir()
    for name, data in FILES.items():
        (root / name).write_bytes(data)
    return root


def digests(df):
    return sorted(tuple(r) for r in df.select("file", "n_bytes", "sha256").collect())


def expected(keep=lambda name: True):
    names = [n for n in FILES if not n.startswith("_") and keep(n)]
    return sorted((n.split("/")[-1], len(FILES[n]), hashlib.sha256(FILES[n]).hexdigest()) for n in names)


@pytest.mark.parametrize("step", [1 << 28, 60_000])
def test_digests_do_not_depend_on_the_rounds(spark, folder, step):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert digests(file_manifest(spark, str(folder), step=step)) == expected()
        assert digests(file_manifest(spark, str(folder), "*.txt", step=step)) == expected(lambda n: n.endswith(".txt"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_file_beyond_the_length_of_a_binary_value(spark, tmp_path):
    """Spark reads no more than this limit (2 GB unless set) into one value; such files failed."""
    (tmp_path / "large.bin").write_bytes(RANDOM)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100_000)
    try:
        assert digests(file_manifest(spark, str(tmp_path), step=100_000)) == [("large.bin", 300_000, hashlib.sha256(RANDOM).hexdigest())]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


@pytest.mark.parametrize("n", [0, 1, 54, 55, 56, 57, 63, 64, 65, 128, 1000])
def test_a_saved_digest_goes_on(n):
    data = RANDOM[:n]
    for cut in range(0, n + 1, 9):
        sha = Sha256(Sha256().take(data[:cut]).saved()).take(data[cut:])
        assert Sha256(sha.saved()).hexdigest(n) == hashlib.sha256(data).hexdigest()
        if n:
            assert sha.hexdigest(n - 1) == hashlib.sha256(data[:-1]).hexdigest()
