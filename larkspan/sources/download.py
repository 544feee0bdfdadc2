"""Fetching an archive of a collection: byte ranges in parallel, taken up again after a failure, checked and unpacked."""

from __future__ import annotations

import hashlib
import os
import time
import urllib.error
import urllib.request
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

#: The MD5 sums of the published archives, by collection.
MD5 = {
    "scifact": "5f7d1de60b170fc8027bb7898e2efca1",
    "nfcorpus": "a89dba18a62ef92f7d323ec890a0d38d",
    "fiqa": "17918ed23cd04fb15047f73e6c3bd9d9",
    "trec-covid": "ce62140cb23feb9becf6270d0d1fe6d1",
    "msmarco": "444067daf65d982533ea17ebd59501e4",
    "nq": "d4d3d2e48787a744b6f6e691ff534307",
    "hotpotqa": "f412724f78b0d91183a0e86805e16114",
}
#: Bytes of a range, and attempts at each.
RANGE, ATTEMPTS = 8_000_000, 5


def described(url: str) -> tuple[int, bool]:
    """The size of what lies at `url`, and whether parts of it can be asked for."""
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as answer:
        return int(answer.headers["Content-Length"]), answer.headers.get("Accept-Ranges", "none").strip().lower() == "bytes"


def fetched(url: str, path: Path, workers: int = 8, size: int = RANGE) -> Path:
    """Download `url` to `path`, which appears only when it is complete.

    The file is written in place next to it, range by range; a list of finished ranges beside it lets a
    later call go on where this one stopped. A server without ranges gives the file in one piece. A
    complete `path` is left as it is.
    """
    total, ranged = described(url)
    if path.exists() and path.stat().st_size == total:
        return path
    work, ledger = path.with_name(path.name + ".work"), path.with_name(path.name + ".ranges")
    step = size if ranged else max(total, 1)
    have = {int(line) for line in ledger.read_text().split()} if ranged and ledger.exists() and work.exists() else set()
    with open(work, "r+b" if have else "wb") as file:
        file.truncate(total)

    def one(start: int) -> int:
        stop = min(start + step, total)
        headers = {"Range": f"bytes={start}-{stop - 1}"} if ranged else {}
        for attempt in range(ATTEMPTS):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
                    content = answer.read()
                if len(content) != stop - start:
                    raise OSError(f"{len(content)} bytes instead of {stop - start}")
                with open(work, "r+b") as file:
                    os.pwrite(file.fileno(), content, start)
                return start
            except (OSError, urllib.error.URLError):
                if attempt + 1 == ATTEMPTS:
                    raise
                time.sleep(0.2 * 2**attempt)
        raise AssertionError

    with ThreadPoolExecutor(max_workers=workers) as pool, open(ledger, "a") as done:
        for start in pool.map(one, [s for s in range(0, total, step) if s not in have]):
            done.write(f"{start}\n")
            done.flush()
    work.replace(path)
    ledger.unlink()
    return path


def digest(path: Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "md5").hexdigest()


def unpacked(archive: Path, folder: Path) -> None:
    """Unpack a zip archive; a member that would land outside `folder` is an error before anything is written."""
    inside = folder.resolve()
    with zipfile.ZipFile(archive) as packed:
        for name in packed.namelist():
            if not (inside / name).resolve().is_relative_to(inside):
                raise ValueError(f"{name} lies outside the folder")
        packed.extractall(folder)


def collection(url: str, name: str, folder: Path, md5: str | None = None, split: str = "test", workers: int = 8) -> Path:
    """The folder of the collection `name`, fetched from `url`/`name`.zip unless it is there; its sum and its files are checked."""
    target = folder / name
    folder.mkdir(parents=True, exist_ok=True)
    archive = fetched(f"{url}/{name}.zip", folder / f"{name}.zip", workers)
    wanted = md5 or MD5[name]
    if digest(archive) != wanted:
        raise ValueError(f"{archive} has the MD5 sum {digest(archive)}, not {wanted}")
    if not target.exists():
        unpacked(archive, folder)
    lacking = [p for p in ("corpus.jsonl", "queries.jsonl", f"qrels/{split}.tsv") if not (target / p).is_file()]
    if lacking:
        raise ValueError(f"{name} lacks {', '.join(lacking)}")
    return target
