"""Listings of large folders."""

import os

from folioscope.sources import files


def test_times_are_made_by_the_batch(spark, tmp_path, monkeypatch):
    """A folder is listed by one task, so what it does for each file must be little: no object is made for a time."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(30):
        (folder / f"p{i}.md").write_bytes(b"x" * i)
        os.utime(folder / f"p{i}.md", ns=(10**18, 1_700_000_000_123_456_789 + i * 10**9))
    assert all(isinstance(x, int) for _, _, _, x in files._children(str(folder)))
    epoch = lambda c: f"unix_micros({c}) AS t"
    want = {(f"p{i}.md", i, 1_700_000_000_123_456 + i * 10**6) for i in range(30)}
    listed = files.scan_sources(spark, [str(folder), f"{tmp_path}/none"])
    got = {(os.path.basename(r.source_path), r.size, r.t) for r in listed.where("error IS NULL").selectExpr("source_path", "size", epoch("mtime")).collect()}
    assert got == want
    assert [r.mtime for r in listed.where("error IS NOT NULL").collect()] == [None]
    pages = files.scan_pages(spark, str(tmp_path)).selectExpr("path", "size", epoch("mtime")).collect()
    assert {(os.path.basename(r.path), r.size, r.t) for r in pages} == want
