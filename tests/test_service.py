from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from gridspark import service
from gridspark.config import PipelineConfig
from gridspark.kernels import pdf


def call(url, data=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data), timeout=30) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


@pytest.fixture
def base(spark, tmp_path):
    server = service.serve(service.Jobs(spark, tmp_path, PipelineConfig(extraction_preset="offline", dpi=72)), port=0)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def finished(base, job):
    for _ in range(240):
        state = json.loads(call(f"{base}/status/{job}")[1])
        if state["status"] in ("completed", "failed"):
            return state
        time.sleep(0.5)
    raise TimeoutError(job)


def test_upload_status_results_download(base):
    code, body = call(f"{base}/extract", pdf.write([{"texts": [(20, 30, "hello")]}]))
    job = json.loads(body)["job_id"]
    assert code == 202 and finished(base, job)["status"] == "completed"
    code, body = call(f"{base}/results/{job}")
    assert code == 200 and "hello" in json.loads(body)["results"][0]["csv"]
    assert call(f"{base}/download/{job}/table_0.csv")[0] == call(f"{base}/download/{job}/run_stats.json")[0] == 200
    assert call(f"{base}/download/{job}/..%2f..%2fx")[0] == 404
    assert json.loads(call(f"{base}/health")[1])["jobs"]["completed"] == 1


def test_faults(base):
    assert call(f"{base}/extract", b"hello")[0] == 400 and call(f"{base}/nothing", b"x")[0] == 404
    assert call(f"{base}/status/unknown")[0] == 404 and call(f"{base}/results/..")[0] == 404
    job = json.loads(call(f"{base}/extract", b"%PDF-1.4 broken")[1])["job_id"]
    state = finished(base, job)
    assert state["status"] == "failed" and "PdfError" in state["error"]
    assert call(f"{base}/results/{job}")[0] == 409
