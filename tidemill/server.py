"""A small HTTP service: run scripts, infer types of uploaded CSV files, fingerprint scripts.

Scripts run in this process on one Spark session and may load files below ``root`` only.
"""

from __future__ import annotations

import datetime
import json
import os
import re
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from . import __version__, project
from .lang.errors import ScriptError
from .plans.runner import Session
from .sources import sinks
from .sources.infer import declaration

LARGEST = 64 << 20


def inside(root: str):
    """Paths of scripts to paths below ``root``; others are refused."""
    top = os.path.realpath(root)

    def path_of(path: str) -> str:
        full = os.path.realpath(os.path.join(top, path))
        if "://" in path or not (full == top or full.startswith(top + os.sep)):
            raise ScriptError("data", f"'{path}' is outside the service's folder")
        return full

    return path_of


def execute(spark: SparkSession, code: str, root: str) -> dict:
    session = Session(spark, path_of=inside(root), keep=True)
    try:
        df = session.run(code)
        got = sinks.result(df) if df is not None else {"rows": [], "schema": []}
        return {"success": True, **got, "logs": session.errors, "charts": session.charts, "error": None}
    except (ScriptError, PySparkException) as e:
        return {"success": False, "rows": [], "schema": [], "logs": session.errors, "charts": [], "error": str(e)}
    finally:
        session.close()


def uploaded(kind: str, body: bytes) -> tuple[str, bytes]:
    """Name and bytes of the first file of a multipart body."""
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + body)
    for part in message.iter_parts():
        if part.get_filename():
            return os.path.basename(part.get_filename()), part.get_payload(decode=True)
    raise ValueError("no file in the request")


def respond(spark: SparkSession, root: str, method: str, path: str, kind: str, body: bytes) -> tuple[int, dict]:
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok", "version": __version__, "timestamp": datetime.datetime.now(datetime.UTC).isoformat()}
    if method != "POST":
        return 404, {"error": "not found"}
    try:
        if path == "/schema":
            name, raw = uploaded(kind, body)
            text = declaration(name, raw, nullable=False)
            fields = [{"name": n, "type": t} for n, t in re.findall(r"^  (.+): (\w+),$", text, re.M)]
            return 200, {"schema": text, "fields": fields}
        given = json.loads(body)
        if path == "/execute":
            return 200, execute(spark, given["code"], root)
        if path == "/security/audit":
            return 200, {"hash": project.fingerprint(given["code"]), "algorithm": "SHA-256"}
        if path == "/security/verify":
            return 200, {"valid": project.verified(given["code"], given["hash"])}
    except (ValueError, KeyError, TypeError) as e:
        return 400, {"error": f"bad request: {e}"}
    return 404, {"error": "not found"}


def serve(spark: SparkSession, port: int, root: str) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            size = int(self.headers.get("Content-Length") or 0)
            if size > LARGEST:
                status, out = 413, {"error": "too large"}
            else:
                status, out = respond(spark, root, self.command, self.path, self.headers.get("Content-Type", ""), self.rfile.read(size))
            body = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = _answer

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
