"""The command line: ``extract`` tables of PDF files, run a ``benchmark``, check ``gates``, compare two ``manifests``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import MISSING, fields
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridspark import config as C
from gridspark import log, manifest
from gridspark.clients.llm import Client, provider
from gridspark.operators import order, runstats
from gridspark.plans import benchmark
from gridspark.plans import extract as E
from gridspark.schemas import PAGE_KEY, TABLE_KEY
from gridspark.sinks import files, report, xlsx

SHOWN = 5


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridspark")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="extract tables")
    e.add_argument("input", help="a file, folder or pattern on any file system that Spark reads")
    e.add_argument("--output", default="out")
    e.add_argument("--excel", help="also write a workbook here")
    _settings(e)
    b = sub.add_parser("benchmark", help="extract annotated files and report how well")
    b.add_argument("dataset", help="a folder with annotations and pdfs")
    b.add_argument("--output", default="benchmark_results", help="a folder of this machine")
    b.add_argument("--subset", help="smoke: the first five; full; or a part of the names")
    b.add_argument("--baseline", help="an earlier report.json")
    b.add_argument("--thresholds", help="a YAML or JSON file")
    _settings(b)
    g = sub.add_parser("gates", help="check a report against thresholds")
    g.add_argument("--results", required=True)
    g.add_argument("--thresholds", required=True)
    m = sub.add_parser("manifests", help="show what differs between two runs")
    m.add_argument("first")
    m.add_argument("second")
    return p


def _settings(e: argparse.ArgumentParser) -> None:
    """One flag per setting, named like it."""
    e.add_argument("--config", help="a YAML or JSON file of settings")
    for f in fields(C.PipelineConfig):
        kind = str(f.type).split(" |")[0]
        flag = "--" + f.name.replace("_", "-")
        if f.name == "input_path":
            continue
        if f.name == "page_indices":
            e.add_argument("--pages", dest="page_indices", type=C.parse_pages, help="such as 0,2-5")
        elif kind == "bool":
            e.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        else:
            e.add_argument(flag, type={"int": int, "float": float}.get(kind, str), default=None, help=None if f.default is MISSING else f"default {f.default}")


def _client(cfg: C.PipelineConfig) -> Client | None:
    """The model's provider where pages are shown to it, or single cells and there is a key to ask with."""
    if cfg.extraction_strategy == "heuristic" and not (cfg.llm_fallback_enabled and cfg.llm_api_key):
        return None
    return provider(cfg.llm_provider, cfg.llm_model or "", cfg.llm_api_key or "")


def _given(args: argparse.Namespace) -> dict:
    return {f.name: getattr(args, f.name, None) for f in fields(C.PipelineConfig) if f.name != "input_path"}


def _summary(stats: dict, odd: list, errors: list[str]) -> str:
    lines = [f"{k}: {v}" for k, v in stats.items() if k not in ("errors", "models_used")]
    lines += [f"irregular: {r['table_id']} {', '.join(r['irregularities'])}" for r in odd[:SHOWN]]
    lines += [f"error: {x}" for x in errors[:SHOWN]]
    return "\n".join(lines)


def _benchmark(spark: SparkSession, args: argparse.Namespace) -> int:
    cfg = C.load(args.config, _given(args))
    work = f"{args.output.rstrip('/')}/{manifest.run_id()}"
    extract = lambda found: E.extract(found, cfg, _client(cfg), f"{work}/attempts", work_path=f"{work}/work")
    baseline, limits = (benchmark.settings(x) if x else None for x in (args.baseline, args.thresholds))
    got = benchmark.run(spark, args.dataset, extract, args.output, args.subset, baseline, limits)
    print("\n".join([*(f"{k}: {v:.4f}" for k, v in got.metrics.items()), "interval: {:.4f} to {:.4f}".format(*got.interval)]))
    print("\n".join([*(f"no file: {x}" for x in got.lonely[:SHOWN]), *(f"failed: {x}" for x in got.failures)]))
    return int(bool(got.failures))


def _gates(spark: SparkSession, args: argparse.Namespace) -> int:
    limits = benchmark.settings(args.thresholds)
    numbers = {k: float(v) for k, v in benchmark.settings(args.results).items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    found = spark.createDataFrame([tuple(numbers.values())], ", ".join(f"`{k}` double" for k in numbers))
    failures = benchmark.missed(found, limits.get("thresholds", {}))
    print("\n".join(f"failed: {x}" for x in failures) or "all gates passed")
    return int(bool(failures))


def _manifests(spark: SparkSession, args: argparse.Namespace) -> int:
    first, second = (manifest.read(spark, x) for x in (args.first, args.second))
    rows = runstats.manifest_diff(first, second).orderBy("kind", "name").collect()
    print("\n".join(f"{r['kind']} {r['name']}: {r['first']} -> {r['second']}" for r in rows) or "no difference")
    return int(bool(rows))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    return {"extract": _extract, "benchmark": _benchmark, "gates": _gates, "manifests": _manifests}[args.command](spark, args)


def _extract(spark: SparkSession, args: argparse.Namespace) -> int:
    cfg = C.load(args.config, _given(args))
    logger = log.configure(cfg.log_level, cfg.log_file, cfg.log_format)
    id_ = manifest.run_id()
    where = f"{args.output.rstrip('/')}/{id_}"
    found = spark.read.format("binaryFile").load(args.input).select("path", "content")
    got = E.extract(found, cfg, _client(cfg), f"{where}/attempts", work_path=f"{where}/work")
    tables = order.number(got.rows(), *TABLE_KEY, name="table_no").withColumn("table_no", F.col("table_no").cast("int"))
    stats = got.stats().first().asDict(recursive=True)
    logger.info("extracted", extra={"run_id": id_, "tables": stats["tables_extracted"]})
    files.OutputSink("filesystem", args.output).write(id_, manifest.create(cfg, id_=id_), stats, tables.select("table_no", "columns", "rows"))
    ordered = tables.orderBy(*TABLE_KEY)
    if args.excel:
        sure = report.confidences(got.cells, TABLE_KEY)
        rows = ordered.join(sure, TABLE_KEY, "left").orderBy(*TABLE_KEY).toLocalIterator()
        xlsx.write(args.excel, [xlsx.Sheet(r["table_id"], r["columns"], r["rows"], r["confidences"]) for r in rows])
    if cfg.enable_debug_artifacts and cfg.generate_html_report:
        html = report.table_html(got.cells, TABLE_KEY).join(got.tables.select(*TABLE_KEY, "table_id"), TABLE_KEY)
        rows = [(r["page_index"], r["table_id"], r["html"]) for r in html.toLocalIterator()]
        folder = Path(cfg.debug_output_dir)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "report.html").write_text(report.run_report(stats, rows, stats["errors"]), encoding="utf-8")
    if cfg.enable_debug_artifacts and cfg.generate_overlays and got.layout is not None:
        shapes = report.overlay_shapes(got.tables.select(*PAGE_KEY, "bbox", "section_label"), got.layout, PAGE_KEY)
        folder = Path(cfg.debug_output_dir) / "overlays"
        folder.mkdir(parents=True, exist_ok=True)
        for i, r in enumerate(report.overlays(shapes, got.sizes, PAGE_KEY).orderBy(*PAGE_KEY).toLocalIterator()):
            (folder / f"{i:05d}_page_{r['page_index']}.png").write_bytes(bytes(r["png"]))
    odd = got.tables.filter("size(irregularities) > 0").orderBy(*TABLE_KEY).limit(SHOWN).collect()
    print(_summary(stats, odd, stats["errors"] or []))
    print(json.dumps({"run_id": id_, "output": where}))
    return int(bool(stats["tables_failed"] or stats["pages_skipped"]))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("gridspark").getOrCreate()
    try:
        return run(spark, args)
    except KeyboardInterrupt:
        spark.sparkContext.cancelAllJobs()
        return 130


if __name__ == "__main__":
    sys.exit(main())
