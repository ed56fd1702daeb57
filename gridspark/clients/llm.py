"""Calling vision models: providers, recorded answers, retries and escalation in one Arrow pass."""

from __future__ import annotations

import base64
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from gridspark.schemas import ATTEMPTS

PROMPT = (
    "Find every table on this page. Answer with JSON only: "
    '{"tables": [{"table_id": "...", "columns": ["..."], "rows": [["..."]]}]}. Use "" for empty cells and keep the printed text.'
)
TEMPERATURE = 0.1
MAX_TOKENS = 4000


@dataclass(frozen=True)
class Answer:
    text: str
    tokens_in: int = 0
    tokens_out: int = 0


class Client(Protocol):
    """Must pickle; one is sent to every worker."""

    def complete(self, model: str, prompt: str, image: bytes, seed: int) -> Answer: ...


@dataclass
class Recorded:
    """Answers by (model, attempt), in order of the most specific key; an exception in place of an answer is raised."""

    answers: dict[tuple[str, int], str | Exception] = field(default_factory=dict)

    def complete(self, model: str, prompt: str, image: bytes, seed: int) -> Answer:
        found = self.answers.get((model, seed), self.answers.get((model, -1)))
        if found is None:
            raise LookupError(f"no recorded answer of {model} for attempt {seed}")
        if isinstance(found, Exception):
            raise found
        return Answer(found, len(prompt) // 4 + 1000, len(found) // 4)


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310
        return json.load(reply)


@dataclass
class Google:
    key: str
    base: str = "https://generativelanguage.googleapis.com/v1beta/models"
    timeout: float = 120.0

    def body(self, prompt: str, image: bytes) -> dict:
        part = {"inline_data": {"mime_type": "image/png", "data": base64.b64encode(image).decode()}}
        return {"contents": [{"parts": [{"text": prompt}, part]}], "generationConfig": {"temperature": TEMPERATURE}}

    def complete(self, model: str, prompt: str, image: bytes, seed: int) -> Answer:
        reply = _post(f"{self.base}/{model}:generateContent", self.body(prompt, image), {"x-goog-api-key": self.key}, self.timeout)
        text = "".join(p.get("text", "") for p in reply["candidates"][0]["content"]["parts"])
        used = reply.get("usageMetadata", {})
        return Answer(text, used.get("promptTokenCount") or len(prompt) // 4 + 1000, used.get("candidatesTokenCount") or len(text) // 4)


@dataclass
class OpenAI:
    key: str
    base: str = "https://api.openai.com/v1"
    timeout: float = 120.0

    def body(self, model: str, prompt: str, image: bytes) -> dict:
        url = "data:image/png;base64," + base64.b64encode(image).decode()
        content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": url}}]
        return {"model": model, "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS, "messages": [{"role": "user", "content": content}]}

    def complete(self, model: str, prompt: str, image: bytes, seed: int) -> Answer:
        reply = _post(f"{self.base}/chat/completions", self.body(model, prompt, image), {"Authorization": f"Bearer {self.key}"}, self.timeout)
        used = reply.get("usage", {})
        return Answer(reply["choices"][0]["message"]["content"] or "", used.get("prompt_tokens", 0), used.get("completion_tokens", 0))


def provider(name: str | None, model: str, key: str) -> Client:
    return Google(key) if name == "google" or "gemini" in model.lower() else OpenAI(key)


def retryable(error: str) -> bool:
    low = error.lower()
    return any(c in error for c in ("500", "503", "429")) or any(w in low for w in ("internal error", "timeout", "deadline exceeded"))


def _parses(text: str) -> bool:
    body = text.strip()
    if "```" in body:
        body = body.split("```", 1)[1]
        body = body.split("\n", 1)[1] if "\n" in body else body
        body = body.rsplit("```", 1)[0] if "```" in body else body
    try:
        return isinstance(json.loads(body), dict)
    except ValueError:
        return False


def call_pages(pages: DataFrame, client: Client, primary: str, escalation: str | None, attempts: int, prompt: str = PROMPT, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``pages(doc_id, page_index, image)`` -> a row per call, failed ones with their error.

    ``attempts`` calls of the primary model are made, so that votes have something to count; the escalation model is only
    asked where none of them gave an answer that parses. After a call that fails for good, an answer that is no JSON
    among them, the model's other attempts are not made; an error that passes is waited for, 1, 2, 4, ... 10 seconds. Write the result to a table before using it twice: a
    retried task calls again.
    """

    def tier(name: str, model: str, doc_id: str, page: int, image: bytes) -> list[dict]:
        out = []
        for i in range(attempts):
            row = {"doc_id": doc_id, "page_index": page, "tier": name, "attempt": i, "model": model}
            try:
                a = client.complete(model, prompt, image, i)
                error = None if _parses(a.text) else "answer is not JSON"
                row |= {"response": a.text, "tokens_in": a.tokens_in, "tokens_out": a.tokens_out, "error": error}
            except Exception as e:  # noqa: BLE001  a failed call is data
                row["error"] = f"{type(e).__name__}: {e}"
            out.append(row)
            if row["error"]:
                if not retryable(row["error"]):
                    break
                if i + 1 < attempts:
                    sleep(min(2.0**i, 10.0))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, longs = ("doc_id", "tier", "model", "response", "error"), ("tokens_in", "tokens_out")
        names = [c.split()[0] for c in ATTEMPTS.split(", ")]
        schema = pa.schema([(c, pa.string() if c in strings else pa.int64() if c in longs else pa.int32()) for c in names])
        for b in batches:
            for doc_id, page, image in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows = tier("primary", primary, doc_id, page, image or b"")
                if escalation and all(r["error"] for r in rows):
                    rows += tier("escalation", escalation, doc_id, page, image or b"")
                yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.select("doc_id", "page_index", "image").mapInArrow(run, ATTEMPTS)


CELL_PROMPT = "Read the text of this table cell (row {row}, column {col}). Answer with the text only."
BLANK_CELL = (100, 50)


def crop(gray, box, pad: int = 0) -> bytes:
    """A cell of a page image as PNG; a white stand-in for a cell without a box or outside the page."""
    import numpy as np

    from gridspark.kernels import raster

    if box is not None:
        h, w = gray.shape
        x0, y0, x1, y1 = (int(v) for v in box)
        part = gray[max(0, y0 - pad) : min(h, y1 + pad), max(0, x0 - pad) : min(w, x1 + pad)]
        if part.size:
            return raster.png(part)
    return raster.png(np.full(BLANK_CELL[::-1], 255, np.uint8))


def call_cells(cells: DataFrame, client: Client, model: str, keys: list[str]) -> DataFrame:
    """``keys, row_index, col_index, image`` -> ``keys, row_index, col_index, answer, error`` for :func:`assemble.llm_fallback`.

    Filter the cells to those that need it first, and write the result to a table before using it twice.
    """
    kept = [*keys, "row_index", "col_index"]
    kinds = dict(cells.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers, errors = [], []
            for r, c, image in zip(*(b.column(x).to_pylist() for x in ("row_index", "col_index", "image")), strict=True):
                try:
                    answers.append(client.complete(model, CELL_PROMPT.format(row=r, col=c), image or b"", 0).text.strip())
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a failed call is data
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            cols = [*(b.column(k) for k in kept), pa.array(answers, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "answer", "error"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in kept) + ", answer string, error string"
    return cells.select(*kept, "image").mapInArrow(run, schema)
