"""Optional types from a language server, for names assigned from lower-case calls.

Off by default.  Any failure means no types, never a failed build.
"""

from __future__ import annotations

import json
import shutil
import subprocess
import tempfile
import threading
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions import naming
from treeloom.plans.staging import ship

COMMAND = ("pyright-langserver", "--stdio")


def available() -> bool:
    return shutil.which(COMMAND[0]) is not None


class Connection:
    """JSON-RPC with ``Content-Length`` framing over two byte streams."""

    def __init__(self, reader, writer) -> None:
        self.reader, self.writer, self.last = reader, writer, 0

    def send(self, **message) -> None:
        body = json.dumps({"jsonrpc": "2.0", **message}).encode()
        self.writer.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
        self.writer.flush()

    def receive(self) -> dict | None:
        length, line = 0, b""
        while header := (line := self.reader.readline()).strip():
            name, _, value = header.partition(b":")
            if name.strip().lower() == b"content-length":
                length = int(value)
        return json.loads(self.reader.read(length)) if line and length else None

    def notify(self, method: str, params: dict) -> None:
        self.send(method=method, params=params)

    def ask(self, method: str, params: dict) -> dict | None:
        self.last += 1
        self.send(id=self.last, method=method, params=params)
        # servers send any number of notes before an answer
        while (message := self.receive()) is not None and message.get("id") != self.last:
            pass
        return message


def hover_text(response: dict | None) -> str | None:
    """The text of a hover answer, plain or in a ``value``."""
    contents = ((response or {}).get("result") or {}).get("contents")
    return contents.get("value", "") if isinstance(contents, dict) else contents if isinstance(contents, str) else None


def hovers(root: Path, sites: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int, str]]:
    """Hover texts at all sites of a source tree, from one server process."""
    pipes = dict.fromkeys(("stdin", "stdout", "stderr"), subprocess.PIPE)
    process = subprocess.Popen(COMMAND, **pipes)
    threading.Thread(target=lambda: [None for _ in iter(process.stderr.readline, b"")], daemon=True).start()
    try:
        link, uri = Connection(process.stdout, process.stdin), root.resolve().as_uri()
        # Without a workspace folder the server looks at files one by one and knows less.
        wanted = dict(workspace=dict(workspaceFolders=True), textDocument=dict(hover=dict(contentFormat=["plaintext"])))
        link.ask("initialize", dict(capabilities=wanted, workspaceFolders=[dict(name=root.name, uri=uri)], rootUri=uri, processId=None))
        link.notify("initialized", {})
        for path, places in sites.items():
            file = root / path
            own = dict(uri=file.resolve().as_uri())
            link.notify("textDocument/didOpen", dict(textDocument=own | dict(text=file.read_text("utf-8", "replace"), version=1, languageId="python")))
            for line, col in places:
                text = hover_text(link.ask("textDocument/hover", dict(position=dict(character=col, line=line), textDocument=own)))
                if text:
                    yield path, line, col, text
            link.notify("textDocument/didClose", dict(textDocument=own))
        link.ask("shutdown", {})
        link.notify("exit", {})
    finally:
        try:
            process.wait(5)
        except subprocess.TimeoutExpired:
            process.kill()


def resolve_types(files: DataFrame, sites: DataFrame) -> DataFrame:
    """``(repo, commit, path, line, col, type)``.

    A snapshot's files and sites go to one task, which writes the tree to its own
    scratch folder and starts one server; snapshots run in parallel.
    """
    ddl = "repo string, commit string, path string, line int, col int, hover string"

    def run(left: Iterator[pa.Table], right: Iterator[pa.Table]) -> pa.Table:
        tree, asked = left.to_pylist(), right.to_pylist()
        rows: list[dict] = []
        try:
            with tempfile.TemporaryDirectory() as scratch:  # this task's own; gone when it ends
                for file in tree:
                    target = Path(scratch) / file["path"]
                    target.parent.mkdir(parents=True, exist_ok=True)
                    content = file["content"]
                    target.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8", "replace"))
                places: dict[str, list[tuple[int, int]]] = {}
                for s in asked:
                    places.setdefault(s["path"], []).append((s["line"], s["col"]))
                if places and available():
                    snap = {"repo": asked[0]["repo"], "commit": asked[0]["commit"]}
                    rows = [{**snap, "path": p, "line": n, "col": c, "hover": text} for p, n, c, text in hovers(Path(scratch), places)]
        except Exception:  # no types are better than no graph
            rows = []
        schema = pa.schema([("repo", pa.string()), ("commit", pa.string()), ("path", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("hover", pa.string())])
        return pa.Table.from_pylist(rows, schema=schema)

    ship(files.sparkSession)
    source = files.select("repo", "commit", "path", "content").groupBy("repo", "commit")
    wanted = sites.select("repo", "commit", "path", "line", "col").groupBy("repo", "commit")
    texts = source.cogroup(wanted).applyInArrow(run, ddl)
    return texts.withColumn("type", naming.hover_type(F.col("hover"))).filter("type is not null").drop("hover")
