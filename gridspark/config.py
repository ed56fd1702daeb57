"""Pipeline settings: defaults, presets, validation, and layers from environment, file and command line."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any

ENV_PREFIX = "GRIDSPARK_"
TRUE = ("true", "1", "yes", "on")
SECRETS = ("llm_api_key", "api_key")


@dataclass(frozen=True)
class PipelineConfig:
    input_path: str | None = None
    page_indices: tuple[int, ...] | None = None
    dpi: int = 200
    extraction_preset: str = "smart"
    extraction_strategy: str = "llm_end_to_end"
    default_rows: int = 2
    default_cols: int = 3
    ocr_confidence_threshold: float = 0.5
    llm_fallback_enabled: bool = False
    llm_provider: str | None = "google"
    llm_model: str | None = "gemini-2.5-pro"
    llm_model_escalation: str | None = "gemini-3.0-pro"
    llm_api_key: str | None = None
    enable_auto_escalation: bool | None = None
    llm_consistency_attempts: int = 1
    llm_consistency_threshold: float = 0.8
    enable_position_verification: bool = False
    position_verification_threshold: float = 0.7
    position_search_radius: float = 50.0
    log_level: str = "INFO"
    log_file: str | None = None
    log_format: str = "human"
    enable_debug_artifacts: bool = False
    debug_output_dir: str = "debug_output"
    generate_overlays: bool = True
    generate_html_report: bool = True
    worker_type: str = "thread"
    max_workers: int | None = None
    page_batch_size: int = 4
    max_inflight_pages: int | None = None
    run_timeout_seconds: float | None = None
    enable_irregular_structure_detection: bool = False
    ragged_mode: str = "strict"
    ragged_fill_value: str | None = None
    enable_section_detection: bool = False
    enable_line_detection: bool = True
    line_detection_min_length: int = 40
    line_detection_gap_tolerance: int = 5
    line_detection_morph_iterations: int = 2
    line_detection_min_separation: int = 5

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        if self.extraction_preset not in PRESETS:
            raise ValueError(f"extraction_preset must be one of {sorted(PRESETS)}, got {self.extraction_preset}")
        forced, filled = PRESETS[self.extraction_preset]
        for k, v in forced.items():
            put(k, v)
        for k, v in filled.items():
            if getattr(self, k) is None:
                put(k, v)
        put("worker_type", (self.worker_type or "thread").lower())
        if self.page_indices is not None:
            put("page_indices", tuple(self.page_indices))
        for name, ok, rule in _RULES:
            if not ok(getattr(self, name)):
                raise ValueError(f"{name} {rule}, got {getattr(self, name)}")


#: What a preset always sets, and what it sets where nothing is given.
PRESETS: dict[str, tuple[dict[str, Any], dict[str, Any]]] = {
    "smart": (
        {"extraction_strategy": "llm_end_to_end"},
        {"llm_provider": "google", "llm_model": "gemini-2.5-pro", "llm_model_escalation": "gemini-3.0-pro", "enable_auto_escalation": False},
    ),
    "premium": (
        {"extraction_strategy": "llm_end_to_end", "llm_model": "gemini-3.0-pro", "llm_model_escalation": None},
        {"llm_provider": "google", "enable_auto_escalation": False},
    ),
    "offline": ({"extraction_strategy": "heuristic", "llm_fallback_enabled": False}, {"enable_auto_escalation": False}),
}


def _within(x) -> bool:
    return 0.0 <= x <= 1.0


def _positive(x) -> bool:
    return x is None or x > 0


_RULES = (
    ("ocr_confidence_threshold", _within, "must lie between 0 and 1"),
    ("llm_consistency_threshold", _within, "must lie between 0 and 1"),
    ("max_workers", _positive, "must be positive"),
    ("page_batch_size", lambda x: x > 0, "must be positive"),
    ("max_inflight_pages", _positive, "must be positive"),
    ("run_timeout_seconds", _positive, "must be positive"),
    ("line_detection_min_separation", lambda x: x >= 0, "must not be negative"),
    ("llm_consistency_attempts", lambda x: x >= 1, "must be at least 1"),
    ("ragged_mode", lambda x: x in ("strict", "ragged"), "must be strict or ragged"),
    ("extraction_strategy", lambda x: x in ("heuristic", "llm_end_to_end"), "must be heuristic or llm_end_to_end"),
    ("worker_type", lambda x: x in ("sequential", "thread"), "must be sequential or thread"),
    ("log_format", lambda x: x in ("human", "json"), "must be human or json"),
)

_KINDS = {f.name: str(f.type).split(" |")[0] for f in fields(PipelineConfig)}


def parse_pages(text: str) -> list[int]:
    """``"0,2-5,10"`` -> page numbers in order, repeats kept; ValueError for anything else."""
    out: list[int] = []
    for part in text.split(","):
        a, dash, b = part.strip().partition("-")
        first = int(a)
        last = int(b) if dash else first
        if first > last:
            raise ValueError(f"range {part.strip()} runs backwards")
        out.extend(range(first, last + 1))
    return out


def from_env(environ: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings named ``GRIDSPARK_<FIELD>``; values that do not parse are left out."""
    environ = os.environ if environ is None else environ
    out: dict[str, Any] = {}
    for name, kind in _KINDS.items():
        raw = environ.get(ENV_PREFIX + name.upper())
        if raw is None:
            continue
        try:
            if name == "page_indices":
                out[name] = parse_pages(raw)
            else:
                out[name] = raw.lower() in TRUE if kind == "bool" else {"int": int, "float": float}.get(kind, str)(raw)
        except ValueError:
            continue
    return out


def from_file(path: str | Path) -> dict[str, Any]:
    """A YAML or JSON mapping; an empty YAML file is an empty one."""
    path = Path(path)
    if path.suffix.lower() in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    if path.suffix.lower() == ".json":
        return json.loads(path.read_text(encoding="utf-8"))
    raise ValueError(f"unsupported config file: {path.suffix}")


def merge(*layers: Mapping[str, Any] | None) -> dict[str, Any]:
    """Later layers win; None means not given."""
    out: dict[str, Any] = {}
    for layer in layers:
        out |= {k: v for k, v in (layer or {}).items() if v is not None}
    return out


def load(file: str | Path | None = None, given: Mapping[str, Any] | None = None, environ: Mapping[str, str] | None = None) -> PipelineConfig:
    """Defaults, then environment, then file, then what is given; names that are no setting are ignored."""
    found = merge(from_env(environ), from_file(file) if file else None, given)
    return PipelineConfig(**{k: v for k, v in found.items() if k in _KINDS})


def digest(config: PipelineConfig | Mapping[str, Any]) -> str:
    """SHA-256 of the sorted JSON of the settings without secrets."""
    import hashlib

    items = asdict(config) if isinstance(config, PipelineConfig) else dict(config)
    public = {k: v for k, v in items.items() if k not in SECRETS}
    return hashlib.sha256(json.dumps(public, sort_keys=True, default=str).encode()).hexdigest()
