"""Links of listings and downloads from a local server."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from helioframe.sources import download, links

HTML = """<a href="a.fits">x</a><A HREF='b.FITS'>x</A><a class="q>r" href="c.fits.gz">x</a><a href="/rooted.fits">x</a>
<a href="d.fits?x=1">x</a><a href="file_index_01.fits">x</a><a href="README.fits">x</a><a href="../e.fits">x</a>
<a href="http://h/f.fits">x</a><a href="a.fits">x</a><a name="no">x</a>"""


def test_file_links(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id long, html string")
    got = [r["href"] for r in links.file_links(pages, ["fits"]).orderBy("pos").collect()]
    assert got == ["a.fits", "b.FITS", "http://h/f.fits", "a.fits"]
    flags = {r["href"]: r for r in links.classified(links.links(pages), ["fits"]).collect()}
    assert flags["/rooted.fits"]["rooted"] and flags["d.fits?x=1"]["has_query"] and flags["README.fits"]["skipped"] and not flags["c.fits.gz"]["has_ext"]


@pytest.fixture(scope="module")
def server():
    seen: dict[str, int] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] = seen.get(self.path, 0) + 1
            ok = self.path in ("/a", "/dir/") or (self.path == "/flaky" and seen[self.path] > 1)
            self.send_response(200 if ok else 500 if self.path == "/flaky" else 404)
            self.end_headers()
            if ok:
                self.wfile.write(HTML.encode() if self.path == "/dir/" else b"body")

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_downloads(spark, server, tmp_path):
    url, seen = server
    tasks = [(f"{url}/a", str(tmp_path / "x" / "a")), (f"{url}/flaky", str(tmp_path / "f")), (f"{url}/none", str(tmp_path / "n"))]
    assert download.download_parallel(spark, tasks, max_retries=1, parallel=2, wait=0.01) == {"downloaded": 2, "failed": 1}
    assert (tmp_path / "x" / "a").read_bytes() == b"body" and not list(tmp_path.glob("*.part")) and not (tmp_path / "n").exists()
    before = seen["/a"]
    assert download.download_single_file(*tasks[0]) and seen["/a"] == before
    assert download.download_parallel(spark, []) == {"downloaded": 0, "failed": 0}


def test_listing(spark, server):
    url, _ = server
    assert {r["href"] for r in links.get_file_list(spark, f"{url}/dir", ["fits"]).collect()} == {"a.fits", "b.FITS", "http://h/f.fits"}
    bad = links.get_file_list(spark, f"{url}/nowhere", ["fits"]).collect()
    assert len(bad) == 1 and bad[0]["error"]
