"""Fetching and unpacking, by links to local files."""

import zipfile

import pytest
from corvane.sources import download


def test_fetch(tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("inner/c.csv", "y\n2\n")
    link = lambda n: f"file://{tmp_path}/{n}"
    setups = {"a": {"dataset": {"download_link": link("a.csv"), "download_path": "A"}}, "b": {"dataset": {"download_link": link("b.zip"), "download_path": "B"}}, "b2": {"dataset": {"download_link": link("b.zip"), "download_path": "B"}}, "none": {"dataset": {}}, "bad": {"dataset": {"download_link": link("missing.csv")}}}
    got = download.fetch_datasets(setups, str(tmp_path / "out"))
    assert got["a"] == got["b"] == got["b2"] == "fetched" and got["none"] == "no link" and got["bad"].startswith("failed")
    assert (tmp_path / "out/A/a.csv").read_text() == "x\n1\n" and (tmp_path / "out/B/inner/c.csv").exists() and not (tmp_path / "out/B/b.zip").exists()
    assert download.fetch_datasets(setups, str(tmp_path / "out"), ["a"]) == {"a": "fetched"}


def test_entries_outside(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        download.unpack(tmp_path / "x.zip", tmp_path / "in")
