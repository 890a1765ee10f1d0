"""Fetching datasets to the driver's machine before they are read or put into shared storage."""

from __future__ import annotations

import shutil
import urllib.request
import zipfile
from pathlib import Path
from urllib.parse import urlparse

TRIES = 3


def fetch(url: str, folder: str, tries: int = TRIES, timeout: float = 60) -> Path:
    """The file at ``url`` in ``folder``; archives are unpacked and removed. An existing file is kept as it is."""
    target = Path(folder) / Path(urlparse(url).path).name
    target.parent.mkdir(parents=True, exist_ok=True)
    if not target.exists():
        part = target.with_suffix(target.suffix + ".part")
        for attempt in range(tries):
            try:
                with urllib.request.urlopen(url, timeout=timeout) as source, part.open("wb") as out:  # noqa: S310
                    shutil.copyfileobj(source, out)
                break
            except OSError:
                if attempt == tries - 1:
                    raise
        part.rename(target)
    if target.suffix.lower() == ".zip":
        unpack(target, Path(folder))
        target.unlink()
        return Path(folder)
    return target


def unpack(archive: Path, folder: Path) -> None:
    """Unpack an archive; an entry that would leave the folder is an error."""
    root = folder.resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{archive} has an entry outside its folder: {name}")
        z.extractall(root)


def fetch_datasets(setups: dict, root: str, names: list[str] | None = None) -> dict[str, str]:
    """Fetch what the setups' datasets link to, each link once; what happened to each setup."""
    done: dict[tuple[str, str], str] = {}
    out = {}
    for name, setup in setups.items():
        dataset = setup.get("dataset", {})
        link = dataset.get("download_link")
        if names and name not in names:
            continue
        if not link:
            out[name] = "no link"
            continue
        key = (link, dataset.get("download_path", ""))
        if key not in done:
            try:
                fetch(link, str(Path(root) / key[1]))
                done[key] = "fetched"
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                done[key] = f"failed: {e}"
        out[name] = done[key]
    return out
