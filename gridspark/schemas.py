"""Schemas of the long-form tables that the operators exchange."""

from __future__ import annotations

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PAGE_KEY = ["doc_id", "page_index"]
TABLE_KEY = [*PAGE_KEY, "table_idx"]

PAGES = "doc_id string, page_index int, width double, height double, image binary, img_w int, img_h int"
TOKENS = f"doc_id string, page_index int, token_idx int, text string, bbox {BBOX}, unit string, confidence double"
REGIONS = f"doc_id string, page_index int, region_idx int, bbox {BBOX}, unit string, confidence double, section_label string"
GRIDS = "doc_id string, page_index int, table_idx int, table_id string, n_rows int, n_cols int, irregularities array<string>, structure_confidence double, section_labels array<string>"
CELLS = (
    "doc_id string, page_index int, table_idx int, cell_ord int, row_index int, col_index int, row_span int, col_span int, "
    f"bbox {BBOX}, text string, text_confidence double, text_source string, structure_confidence double, structure_source string, is_filler boolean"
)
ATTEMPTS = "doc_id string, page_index int, tier string, attempt int, model string, response string, tokens_in bigint, tokens_out bigint, error string"
RESPONSE = "struct<tables:array<struct<table_id:string,columns:array<string>,rows:array<array<string>>>>>"
ANNOTATION_CELL = f"struct<row:int,col:int,rowspan:int,colspan:int,text:string,bbox:{BBOX}>"
ANNOTATION = (
    "pdf_file string, page_index int, metadata map<string,string>, "
    f"tables array<struct<table_id:string,bbox:{BBOX},n_rows:int,n_cols:int,cells:array<{ANNOTATION_CELL}>>>"
)
THRESHOLDS = "metric string, target double, tolerance double, inverted boolean, description string"
MANIFEST = (
    "run_id string, timestamp string, git_commit string, git_branch string, config_digest string, python_version string, platform string, "
    "package_versions map<string,string>, components array<struct<name:string,version:string,type:string,metadata:map<string,string>>>"
)
PAGE_RESULTS = (
    "doc_id string, page_index int, skipped boolean, tables_detected int, tables_extracted int, tables_failed int, cells_with_text int, total_cells int, "
    "llm_fallback_count int, confidence_sum double, confidence_count int, duration_ms double, calls_primary int, calls_escalation int, "
    "tokens_in bigint, tokens_out bigint, model string, errors array<string>"
)
JOBS = "job_id string, path string, status string, created_at timestamp, finished_at timestamp, error string"
TABLE_STATUSES = ("success", "detection_failed", "extraction_failed")
JOB_STATUSES = ("queued", "processing", "completed", "failed")
TEXT_SOURCES = ("ocr", "embedded", "llm_fallback", "mock")
