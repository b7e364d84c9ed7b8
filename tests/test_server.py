import json
import threading
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import urlopen

import pytest

from locusframe.server import serve


def test_server(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "chr1", 5), (2, "chr1", 50), (3, "chr2", 7)], "id int, contig string, position int").write.parquet(path)
    server = serve(spark, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda page, **q: urlopen(f"http://127.0.0.1:{server.server_port}{page}?" + "&".join(f"{k}={quote(str(x))}" for k, x in q.items())).read().decode()
    try:
        assert json.loads(get("/api/schema", path=path))["properties"]["id"]["type"] == ["integer", "null"]
        assert json.loads(get("/api/info", path=path))["columns"] == ["id", "contig", "position"]
        assert [r["id"] for r in json.loads(get("/api/query", path=path, where="id >= 2", interval="chr1:1-60"))] == [2]
        assert len(get("/api/query", path=path, format="ndjson").splitlines()) == 3
        assert json.loads(get("/api/query", path=path, where="contig= chr1", raw=1)) == [] and len(json.loads(get("/api/query", path=path, where="contig= chr1"))) == 2
        assert get("/api/query", path=path, format="sse", limit=1).endswith('event: done\ndata: {"rows": 1}\n\n')
        with pytest.raises(HTTPError):
            get("/api/query", path=path, where="id ~ 2")
        with pytest.raises(HTTPError):
            get("/api/none")
    finally:
        server.shutdown()


def test_an_error_after_the_first_row_is_no_second_answer(spark, tmp_path):
    """The answer breaks off; an error before the first row has a status of its own."""
    import socket

    from pyspark.sql import functions as F

    from locusframe import server

    rows = spark.range(2).select(F.when(F.col("id") == 0, F.lit("a")).otherwise(F.raise_error(F.lit("late"))).alias("x")).repartition(2)
    front = server.serve(spark, 0)
    threading.Thread(target=front.serve_forever, daemon=True).start()

    def ask(path):
        with socket.create_connection(front.server_address, timeout=60) as s:
            s.sendall(f"GET {path} HTTP/1.0\r\n\r\n".encode())
            return b"".join(iter(lambda: s.recv(65536), b"")).decode()

    real = server.chosen
    try:
        said = iter(["a", "b"])

        class Late:
            def toLocalIterator(self):  # noqa: N802
                yield type("R", (), {"json": next(said)})
                raise ValueError("late")

        server.chosen = lambda *_: rows
        lines, server.sinks = server.sinks, type("S", (), {"json_lines": staticmethod(lambda df: Late())})
        try:
            answer = ask("/api/query?path=x&format=ndjson")
        finally:
            server.sinks = lines
        assert answer.count("HTTP/1.0") == 1 and answer.startswith("HTTP/1.0 200") and answer.endswith("a\n")
        server.chosen = real
        assert ask(f"/api/query?path={tmp_path}/none.parquet").startswith("HTTP/1.0 400")
    finally:
        server.chosen = real
        front.shutdown()
