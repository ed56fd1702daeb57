"""What a run was made of: code, settings, packages and components."""

from __future__ import annotations

import json
import platform
import subprocess
import uuid
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime
from importlib import metadata
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gridspark.config import PipelineConfig, digest
from gridspark.schemas import MANIFEST

PACKAGES = ("pyspark", "numpy", "pyarrow", "pandas", "duckdb", "pyyaml")


def run_id() -> str:
    return f"run_{datetime.now(UTC):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


def _git(*args: str) -> str | None:
    try:
        out = subprocess.run(["git", *args], capture_output=True, text=True, timeout=5, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return out.stdout.strip() or None


def _version(name: str) -> str | None:
    try:
        return metadata.version(name)
    except metadata.PackageNotFoundError:
        return None


def create(config: PipelineConfig, components: Iterable[Mapping[str, Any]] = (), id_: str | None = None) -> dict[str, Any]:
    return {
        "run_id": id_ or run_id(),
        "timestamp": datetime.now(UTC).isoformat(),
        "git_commit": _git("rev-parse", "HEAD"),
        "git_branch": _git("rev-parse", "--abbrev-ref", "HEAD"),
        "config_digest": digest(config),
        "python_version": platform.python_version(),
        "platform": platform.platform(),
        "package_versions": {n: v for n in PACKAGES if (v := _version(n))},
        "components": [{"name": c["name"], "version": c["version"], "type": c.get("type"), "metadata": c.get("metadata", {})} for c in components],
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)


def dumps(manifest: Mapping[str, Any]) -> str:
    return json.dumps(manifest, indent=2, sort_keys=True)
