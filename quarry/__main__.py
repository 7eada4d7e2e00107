"""Command line: python -m quarry QUERY --corpus DIR [--json] [--names], --ingest FOLDER to bring the corpus up to date first, or --serve to answer
a line of query with a line of JSON."""

from __future__ import annotations

import argparse
import json
import socketserver
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import filename, sinks
from quarry.operators.ingest import ingest
from quarry.operators.store import Store
from quarry.plans.query import front, plan

#: Hits of a command and of a line to the server.
COMMAND, SERVED = 20, 50


def find(store: Store, text: str, limit: int, names: bool = False, now: int | None = None) -> DataFrame:
    """A page of hits with score, path and title, of texts or of file names. By names no filter applies; its tokens are taken out. names: is what a
    line to the server begins with for that."""
    now = int(time.time()) if now is None else now
    if text.startswith("names:"):
        text, names = text.removeprefix("names:").strip(), True
    if names:
        rest = front(text, now=now).text
        return filename.as_hits(store.search_names("" if rest == "*" else rest, limit))
    return store.search(plan(text, limit=limit, now=now))


def server(store: Store, port: int) -> socketserver.ThreadingTCPServer:
    """Answers each line, a query, with a line of JSON: the hits, or what went wrong."""

    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            for line in self.rfile:
                try:
                    out = json.dumps([json.loads(x) for x in sinks.lines(find(store, line.decode().strip(), SERVED), True)])
                except Exception as e:  # noqa: BLE001  the client is told
                    out = json.dumps({"error": str(e)})
                self.wfile.write(out.encode() + b"\n")

    class Server(socketserver.ThreadingTCPServer):
        allow_reuse_address, daemon_threads = True, True

    return Server(("127.0.0.1", port), Handler)


def main(arguments: list[str] | None = None, show: Callable[[str], None] = print) -> None:
    a = argparse.ArgumentParser()
    a.add_argument("query", nargs="?")
    a.add_argument("--corpus", required=True)
    a.add_argument("--ingest", metavar="FOLDER")
    a.add_argument("--json", action="store_true")
    a.add_argument("--names", action="store_true")
    a.add_argument("--serve", type=int, metavar="PORT")
    args = a.parse_args(arguments)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    store, reset = Store.opened(spark, args.corpus)
    if reset:
        print(f"the corpus could not be read and lies at {args.corpus}.backup", file=sys.stderr)
    if args.ingest:
        ingest(spark, args.ingest, store)
    if args.serve is None:
        show("\n".join(sinks.lines(find(store, args.query or "*", COMMAND, args.names), args.json)))
        return
    with server(store, args.serve) as s:
        s.serve_forever()


if __name__ == "__main__":
    main()
