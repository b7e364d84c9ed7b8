"""A small HTTP front end: /api/info, /api/schema and /api/query as JSON, NDJSON or events.

Rows are streamed partition by partition; nothing is held but one partition.
"""

from __future__ import annotations

import itertools
import json
from argparse import Namespace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from locusframe.cli import chosen
from locusframe.operators import schema
from locusframe.sources import sinks, tables


def handler(spark: SparkSession) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        begun = False

        def log_message(self, *_):
            pass

        def send(self, kind: str, parts, status: int = 200) -> None:
            # The first part is made before anything is sent, so that most errors still have an answer of their own.
            parts = iter(parts)
            first = next(parts, None)
            parts = itertools.chain([] if first is None else [first], parts)
            self.begun = True
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            for part in parts:
                self.wfile.write(part.encode())

        def do_GET(self):  # noqa: N802
            self.begun = False
            url = urlparse(self.path)
            given = parse_qs(url.query, keep_blank_values=True)
            one = lambda n, other=None: given.get(n, [other])[0]
            try:
                if url.path == "/api/schema":
                    self.send("application/json", [json.dumps(schema.generate(tables.open_path(spark, one("path")).schema))])
                elif url.path == "/api/info":
                    df = tables.open_path(spark, one("path"))
                    self.send("application/json", [json.dumps({"columns": df.columns, "partitions": df.rdd.getNumPartitions()})])
                elif url.path == "/api/query":
                    limit = one("limit")
                    ask = Namespace(table=one("path"), where=given.get("where", []), interval=given.get("interval", []), intervals_file=[], limit=int(limit) if limit else None, mode=one("mode", "sql"), request=one("raw") == "1")
                    rows = (r.json for r in sinks.json_lines(chosen(spark, ask)).toLocalIterator())
                    self.rows(one("format", "json"), rows)
                else:
                    self.send("application/json", [json.dumps({"error": "no such page"})], 404)
            except Exception as e:  # noqa: BLE001  the answer says what is wrong with the request
                if self.begun:
                    # An answer that has begun cannot say so any more; it breaks off.
                    self.close_connection = True
                    return
                self.send("application/json", [json.dumps({"error": str(e).splitlines()[0]})], 400)

        def rows(self, form: str, rows) -> None:
            if form == "ndjson":
                self.send("application/x-ndjson", (r + "\n" for r in rows))
            elif form == "sse":
                n = 0

                def events():
                    nonlocal n
                    for n, r in enumerate(rows, 1):
                        yield f"data: {r}\n\n"
                    yield f'event: done\ndata: {{"rows": {n}}}\n\n'

                self.send("text/event-stream", events())
            else:

                def array():
                    # The bracket goes with the first row, which shows that there is an answer.
                    i = -1
                    for i, r in enumerate(rows):
                        yield ("," if i else "[") + r
                    if i < 0:
                        yield "["
                    yield "]"

                self.send("application/json", array())

    return Handler


def serve(spark: SparkSession, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(spark))
