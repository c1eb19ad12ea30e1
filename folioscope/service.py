"""An HTTP service over the pipeline: GET /, GET /health, POST /ocr (multipart: file, and prompt if wanted)."""

from __future__ import annotations

import email.parser
import email.policy
import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from folioscope.plans import pipeline
from folioscope.plans.options import Options
from folioscope.sources import files

HOST, PORT = "0.0.0.0", 8000


def form(content_type: str, body: bytes) -> dict[str, tuple[str | None, bytes]]:
    """(file name, bytes) of each field of a multipart body."""
    message = email.parser.BytesParser(policy=email.policy.HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    parts = message.iter_parts() if message.is_multipart() else []
    return {p.get_param("name", header="content-disposition"): (p.get_filename(), p.get_payload(decode=True) or b"") for p in parts}


def answer(spark: SparkSession, backend: pipeline.Backend, name: str, content: bytes, prompt: str | None = None, options: Options = Options()) -> dict:
    """The service's answer about one upload; ValueError if its suffix isn't taken."""
    rows = files.uploads(spark, [(name, content)]).withColumnRenamed("path", "file_name")
    return json.loads(files.api_form(pipeline.extract_files(rows, backend, prompt, options)).first().value)


def handler(reply: Callable[[str, bytes, str | None], dict]) -> type[BaseHTTPRequestHandler]:
    """A request handler; reply(file name, bytes, prompt) answers uploads."""

    class Handler(BaseHTTPRequestHandler):
        def send(self, status: int, value: dict) -> None:
            body = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            known = {"/": {"service": "folioscope", "status": "running"}, "/health": {"status": "healthy"}}
            self.send(200, known[self.path]) if self.path in known else self.send(404, {"detail": "Not Found"})

        def do_POST(self) -> None:
            if self.path != "/ocr":
                return self.send(404, {"detail": "Not Found"})
            fields = form(self.headers.get("Content-Type", ""), self.rfile.read(int(self.headers.get("Content-Length", 0))))
            name, content = fields.get("file", (None, b""))
            if name is None:
                return self.send(422, {"detail": "file is missing"})
            if not name.lower().endswith(files.SUFFIXES):
                return self.send(400, {"detail": f"Unsupported: {name[name.rfind('.') :].lower() if '.' in name else ''}"})
            try:
                self.send(200, reply(name, content, fields.get("prompt", (None, b""))[1].decode() or None))
            except Exception as e:
                self.send(500, {"detail": str(e)})

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(spark: SparkSession, backend: pipeline.Backend, host: str = HOST, port: int = PORT, options: Options = Options()) -> ThreadingHTTPServer:
    """A server that is bound but doesn't run yet (serve_forever)."""
    return ThreadingHTTPServer((host, port), handler(lambda name, content, prompt: answer(spark, backend, name, content, prompt, options)))
