"""A small HTTP service: files in, jobs, tables out. Jobs are JSON files in one folder, so several processes can share it."""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridspark import manifest
from gridspark.clients.llm import Client
from gridspark.config import PipelineConfig
from gridspark.operators import order
from gridspark.plans import extract as E
from gridspark.schemas import JOB_STATUSES, TABLE_KEY
from gridspark.sinks import files
from gridspark.sources import pdf

MAX_BYTES = 100 << 20
_NAME = re.compile(r"[A-Za-z0-9_.-]+")


class Jobs:
    """Takes files, extracts them one after another in the background, and keeps each job's state."""

    def __init__(self, spark: SparkSession, folder: str | Path, config: PipelineConfig, client: Client | None = None) -> None:
        self.spark, self.folder, self.config, self.client = spark, Path(folder), config, client
        (self.folder / "jobs").mkdir(parents=True, exist_ok=True)
        self.pool = ThreadPoolExecutor(1)

    def _put(self, job: dict[str, Any]) -> None:
        path = self.folder / "jobs" / f"{job['job_id']}.json"
        part = path.with_suffix(".part")
        part.write_text(json.dumps(job), encoding="utf-8")
        part.replace(path)  # readers see the old state or the new one

    def get(self, job_id: str) -> dict[str, Any] | None:
        path = self.folder / "jobs" / f"{job_id}.json"
        return json.loads(path.read_text(encoding="utf-8")) if _NAME.fullmatch(job_id) and path.exists() else None

    def counts(self) -> dict[str, int]:
        found = [json.loads(p.read_text(encoding="utf-8"))["status"] for p in (self.folder / "jobs").glob("*.json")]
        return {s: found.count(s) for s in JOB_STATUSES} | {"total": len(found)}

    def submit(self, name: str, data: bytes) -> str:
        job = {"job_id": uuid.uuid4().hex, "name": name, "status": "queued", "created_at": datetime.now(UTC).isoformat(), "error": None}
        self._put(job)
        self.pool.submit(self._run, job, data)
        return job["job_id"]

    def _run(self, job: dict[str, Any], data: bytes) -> None:
        self._put(job | {"status": "processing"})
        try:
            source = pdf.from_bytes(self.spark, {job["name"]: data})
            got = E.extract(source, self.config, self.client, str(self.folder / "attempts" / job["job_id"]), work_path=str(self.folder / "work" / job["job_id"]))
            tables = order.number(got.rows(), *TABLE_KEY, name="table_no").withColumn("table_no", F.col("table_no").cast("int"))
            stats = got.stats().first().asDict(recursive=True)
            files.OutputSink("filesystem", str(self.folder / "results")).write(job["job_id"], manifest.create(self.config, id_=job["job_id"]), stats, tables)
            failed = not stats["tables_extracted"] and stats["errors"]
            end = {"status": "failed" if failed else "completed", "tables": stats["tables_extracted"], "error": "; ".join(stats["errors"]) or None}
        except Exception as e:  # noqa: BLE001  the job carries its error
            end = {"status": "failed", "error": f"{type(e).__name__}: {e}"}
        self._put(job | end | {"finished_at": datetime.now(UTC).isoformat()})

    def file(self, job_id: str, name: str) -> Path | None:
        """``run_stats.json``, ``manifest.json`` or ``table_<n>.csv`` of a job that has it."""
        if not (_NAME.fullmatch(job_id) and _NAME.fullmatch(name)):
            return None
        base = self.folder / "results" / job_id
        path = base / "tables" / name if name.endswith(".csv") else base / name
        return path if path.is_file() else None

    def results(self, job_id: str) -> list[dict[str, str]]:
        found = (self.folder / "results" / job_id / "tables").glob("table_*.csv")
        ordered = sorted(found, key=lambda p: int(re.search(r"\d+", p.stem)[0]))
        return [{"name": p.name, "csv": p.read_text(encoding="utf-8")} for p in ordered]


def _handler(jobs: Jobs) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: Any, kind: str = "application/json") -> None:
            data = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:  # noqa: N802
            if self.path.split("?")[0] != "/extract":
                return self._send(404, {"error": "not found"})
            size = int(self.headers.get("Content-Length") or 0)
            if not 0 < size <= MAX_BYTES:
                return self._send(413 if size > MAX_BYTES else 400, {"error": f"a body of 1 to {MAX_BYTES} bytes is needed"})
            data = self.rfile.read(size)
            if b"%PDF-" not in data[:1024]:
                return self._send(400, {"error": "not a PDF file"})
            return self._send(202, {"job_id": jobs.submit(self.headers.get("X-File-Name") or "upload.pdf", data), "status": "queued"})

        def do_GET(self) -> None:  # noqa: N802
            parts = self.path.split("?")[0].strip("/").split("/")
            if parts in ([""], ["health"]):
                return self._send(200, {"status": "healthy", "jobs": jobs.counts()})
            job = jobs.get(parts[1]) if len(parts) > 1 else None
            if job is None:
                return self._send(404, {"error": "no such job"})
            if parts[0] == "status" and len(parts) == 2:
                return self._send(200, job)
            if parts[0] == "results" and len(parts) == 2:
                return self._send(200, job | {"results": jobs.results(parts[1])}) if job["status"] == "completed" else self._send(409, job)
            if parts[0] == "download" and len(parts) == 3 and (path := jobs.file(parts[1], parts[2])):
                return self._send(200, path.read_bytes(), "text/csv" if path.suffix == ".csv" else "application/json")
            return self._send(404, {"error": "not found"})

        def log_message(self, *args: Any) -> None:
            """Quiet; jobs are logged by their state."""

    return Handler


def serve(jobs: Jobs, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``: POST /extract, GET /status, /results, /download and /health."""
    return ThreadingHTTPServer((host, port), _handler(jobs))
