"""Fetching from a server on this machine: ranges, resumption, sums, unsafe archives."""

import hashlib
import io
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from larkspan.sources import download


class Shelf(BaseHTTPRequestHandler):
    files, ranges, broken, asked = {}, True, set(), []

    def do_HEAD(self):
        self.send_response(200)
        self.send_header("Content-Length", str(len(self.files[self.path])))
        if self.ranges:
            self.send_header("Accept-Ranges", "bytes")
        self.end_headers()

    def do_GET(self):
        content, wanted = self.files[self.path], self.headers.get("Range")
        self.asked.append(wanted)
        if wanted in self.broken:
            return self.send_error(500)
        if wanted and self.ranges:
            a, b = map(int, wanted.removeprefix("bytes=").split("-"))
            content = content[a : b + 1]
        self.send_response(206 if wanted else 200)
        self.send_header("Content-Length", str(len(content)))
        self.end_headers()
        self.wfile.write(content)

    def log_message(self, *_):
        pass


@pytest.fixture
def shelf(monkeypatch):
    Shelf.files, Shelf.ranges, Shelf.broken, Shelf.asked = {}, True, set(), []
    server = HTTPServer(("127.0.0.1", 0), Shelf)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(download.time, "sleep", lambda _: None)
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def packed(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


@pytest.mark.parametrize("ranges", [True, False])
def test_ranges_and_whole(shelf, tmp_path, ranges):
    Shelf.files["/f"], Shelf.ranges = bytes(range(256)) * 40, ranges
    path = download.fetched(f"{shelf}/f", tmp_path / "f", size=1000)
    assert path.read_bytes() == Shelf.files["/f"] and len(Shelf.asked) == (11 if ranges else 1)
    download.fetched(f"{shelf}/f", tmp_path / "f", size=1000)
    assert len(Shelf.asked) == (11 if ranges else 1) and [p.name for p in tmp_path.iterdir()] == ["f"]


def test_goes_on_where_it_stopped(shelf, tmp_path):
    Shelf.files["/f"] = bytes(range(250)) * 40
    Shelf.broken = {"bytes=7000-7999"}
    with pytest.raises(OSError):
        download.fetched(f"{shelf}/f", tmp_path / "f", 1, 1000)
    assert not (tmp_path / "f").exists()
    Shelf.broken, Shelf.asked = set(), []
    assert download.fetched(f"{shelf}/f", tmp_path / "f", 1, 1000).read_bytes() == Shelf.files["/f"]
    assert Shelf.asked[0] == "bytes=7000-7999"


def test_collection(shelf, tmp_path):
    good = packed(("c/corpus.jsonl", "{}"), ("c/queries.jsonl", "{}"), ("c/qrels/test.tsv", "x"))
    Shelf.files["/c.zip"], Shelf.files["/d.zip"] = good, packed(("d/corpus.jsonl", "{}"))
    told = hashlib.md5(good).hexdigest()
    assert (download.collection(shelf, "c", tmp_path, told) / "qrels/test.tsv").read_text() == "x"
    with pytest.raises(ValueError, match="MD5"):
        download.collection(shelf, "c", tmp_path, "0" * 32)
    with pytest.raises(ValueError, match="lacks"):
        download.collection(shelf, "d", tmp_path, hashlib.md5(Shelf.files["/d.zip"]).hexdigest())


def test_unsafe_archive(tmp_path):
    (tmp_path / "a.zip").write_bytes(packed(("ok.txt", "x"), ("../out.txt", "x")))
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError, match="outside"):
        download.unpacked(tmp_path / "a.zip", tmp_path / "in")
    assert not list((tmp_path / "in").iterdir()) and not (tmp_path / "out.txt").exists()
