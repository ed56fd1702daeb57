"""From boxes and ruling lines to cell grids; sequential rules run as folds inside one array per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import geometry as G

EXPLICIT, FILLER = 0.95, {"ragged": 0.5, "strict": 0.2}


def full_page_regions(pages: DataFrame, confidence: float = 1.0) -> DataFrame:
    box = G.bbox(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    return pages.select("doc_id", "page_index", F.lit(0).alias("region_idx"), box.alias("bbox"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("section_label"))


def panel_regions(boxes: DataFrame, pages: DataFrame, min_area: float = 0.02) -> DataFrame:
    """Raw panel boxes ``(doc_id, page_index, bbox)`` -> regions: large ones, padded, clamped, numbered from the top left.

    Pages without any become one region of the full page with confidence 0.5.
    """
    key = ["doc_id", "page_index"]
    on = boxes.join(pages.select(*key, "width", "height"), key)
    w, h = F.col("width"), F.col("height")
    pad = F.greatest(F.lit(5.0), F.floor(F.least(w, h) * 0.01).cast("double"))
    kept = on.filter(G.area(F.col("bbox")) >= min_area * w * h).withColumn("bbox", G.pad_and_clamp(F.col("bbox"), pad, w, h))
    found = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("bbox.y0").alias("y0"), F.col("bbox.x0").alias("x0"), "bbox"))).alias("all"))
    found = found.select(*key, F.posexplode("all").alias("region_idx", "x"))
    label = F.format_string("section_%d", F.col("region_idx") + 1)
    found = found.select(*key, "region_idx", "x.bbox", F.lit(0.8).alias("confidence"), label.alias("section_label"))
    return found.unionByName(full_page_regions(pages.join(found, key, "left_anti"), 0.5))


def _at(xs: Column, i: Column | int) -> Column:
    return F.try_element_at(xs, F.lit(i) if isinstance(i, int) else i)


def merge_lines(xs: Column, gap, min_separation) -> Column:
    """Positions of lines -> merged ones: a line within ``gap`` of the last one moves it half-way, then close ones go."""
    gap, least = (x if isinstance(x, Column) else F.lit(x) for x in (gap, min_separation))
    empty = F.array().cast("array<double>")

    def replaced(acc: Column, x: Column) -> Column:
        return F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(x))

    def merge(acc: Column, x: Column) -> Column:
        last = _at(acc, -1)
        return F.when(last.isNotNull() & (x - last <= gap), replaced(acc, (last + x) / 2)).otherwise(F.concat(acc, F.array(x)))

    def thin(acc: Column, x: Column) -> Column:
        last = _at(acc, -1)
        return F.when(last.isNotNull() & (x - last < least), acc).otherwise(F.concat(acc, F.array(x)))

    sorted_ = F.array_sort(F.transform(xs, lambda x: x.cast("double")))
    return F.aggregate(F.aggregate(sorted_, empty, merge), empty, thin)


def cluster(xs: Column, threshold) -> Column:
    """Greedy one-dimensional clusters of sorted values: ``array<struct<center,n>>`` in order.

    A value joins the newest cluster if its running mean is within the threshold; as values ascend and older centres
    lie lower, no older cluster could take it.
    """
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    threshold = F.when(threshold <= 0, F.lit(1.0)).otherwise(threshold)

    def one(center: Column, n: Column) -> Column:
        return F.array(F.struct(center.cast("double").alias("center"), n.cast("int").alias("n")))

    def step(acc: Column, x: Column) -> Column:
        last = _at(acc, -1)
        n = last["n"] + 1
        moved = one((last["center"] * (n - 1) + x) / n, n)
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        near = F.coalesce(F.abs(x - last["center"]) <= threshold, F.lit(False))
        return F.when(near, F.concat(head, moved)).otherwise(F.concat(acc, one(x, F.lit(1))))

    return F.aggregate(F.array_sort(F.transform(xs, lambda x: x.cast("double"))), F.array().cast("array<struct<center:double,n:int>>"), step)


def nearest(x: Column, centers: Column) -> Column:
    """The index of the nearest centre, the lowest of equals."""
    ranked = F.transform(centers, lambda c, i: F.struct(F.abs(x - c).alias("d"), i.alias("i")))
    return F.array_min(ranked)["i"]


def relaxed(config: dict) -> dict:
    """A more permissive line-detection setting for thin or faint lines (halves round to even)."""
    scaled = lambda v, k, least: max(least, int(round(v * k)))
    h, v = config["horizontal_kernel"], config["vertical_kernel"]
    return {
        **config,
        "min_line_length": scaled(config["min_line_length"], 0.5, 8),
        "gap_tolerance": scaled(config["gap_tolerance"], 0.7, 3),
        "horizontal_kernel": (scaled(h[0], 0.6, 10), h[1]),
        "vertical_kernel": (v[0], scaled(v[1], 0.6, 10)),
        "morph_iterations": max(1, config["morph_iterations"]),
        "min_line_separation": scaled(config["min_line_separation"], 0.8, 1),
    }


def _intervals(xs: Column) -> Column:
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), pair)


def grid_from_lines(tables: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bbox, h_lines, v_lines`` -> cells between adjacent lines inside the box; no row for fewer than two lines either way."""
    b = F.col("bbox")
    inside = lambda xs, lo, hi: F.array_sort(F.array_distinct(F.filter(xs, lambda x: x.between(lo, hi))))
    t = tables.select(*keys, inside("h_lines", b["y0"], b["y1"]).alias("h"), inside("v_lines", b["x0"], b["x1"]).alias("v"))
    t = t.filter((F.size("h") >= 2) & (F.size("v") >= 2))
    rows = t.select(*keys, "v", F.posexplode(_intervals(F.col("h"))).alias("row_index", "y"))
    cells = rows.select(*keys, "row_index", "y", F.posexplode(_intervals(F.col("v"))).alias("col_index", "x"))
    return cells.select(*keys, "row_index", "col_index", G.bbox("x.a", "y.a", "x.b", "y.b").alias("bbox"))


def even_grid(tables: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, bbox, n_rows, n_cols`` -> cells of the even division; no row for a side of zero or less."""
    t = tables.filter("n_rows > 0 and n_cols > 0")
    t = t.withColumn("row_index", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    t = t.withColumn("col_index", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    box = G.split_cell(F.col("bbox"), F.col("row_index"), F.col("col_index"), F.col("n_rows"), F.col("n_cols"))
    return t.select(*keys, "row_index", "col_index", box.alias("bbox"))


def densify(cells: DataFrame, dims: DataFrame, keys: list[str], mode: str = "strict") -> DataFrame:
    """All positions of ``dims(keys, n_rows, n_cols)``; those without a cell are fillers."""
    at = [*keys, "row_index", "col_index"]
    t = dims.filter("n_rows > 0 and n_cols > 0").withColumn("row_index", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    t = t.withColumn("col_index", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))).select(*at)
    out = t.join(cells.withColumn("_there", F.lit(True)), at, "left")
    filler = F.col("_there").isNull()
    source = F.when(filler, "filler").otherwise("explicit")
    return out.withColumns({"is_filler": filler, "structure_source": source, "structure_confidence": F.when(filler, FILLER[mode]).otherwise(EXPLICIT)}).drop("_there")


def ragged_grid(boxes: DataFrame, keys: list[str], mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Text boxes ``keys, box_idx, bbox, width, height`` (of their region, relative to it) -> (cells, grids).

    Rows and columns are clusters of the centres; a box belongs to its row's cluster and the nearest column, the last
    of a position wins, and its cell is clipped to the column's extent. Empty positions become fillers.
    """
    w, h = F.col("width"), F.col("height")
    big = (F.col("bbox.x1") - F.col("bbox.x0") >= F.greatest(F.lit(8), F.floor(0.01 * w))) & (F.col("bbox.y1") - F.col("bbox.y0") >= F.greatest(F.lit(8), F.floor(0.01 * h)))
    kept = boxes.filter(big).withColumns({"cx": (F.col("bbox.x0") + F.col("bbox.x1")) / 2, "cy": (F.col("bbox.y0") + F.col("bbox.y1")) / 2})
    limit = lambda size: F.greatest(F.lit(4), F.floor(0.02 * size)).cast("double")
    dims = kept.groupBy(*keys, "width", "height").agg(F.collect_list("cx").alias("xs"), F.collect_list("cy").alias("ys"))
    dims = dims.select(*keys, cluster(F.col("xs"), limit(w)).alias("cols"), cluster(F.col("ys"), limit(h)).alias("rows"))
    n_after = lambda cs: F.transform(cs, lambda c, i: F.aggregate(F.slice(cs, F.lit(1), i + 1), F.lit(0), lambda s, y: s + y["n"]))
    dims = dims.withColumn("row_ends", n_after(F.col("rows")))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("cy", "box_idx"))
    placed = kept.withColumn("rank", rank).join(dims, keys)
    row = F.size(F.filter("row_ends", lambda e: e < F.col("rank")))
    col = nearest(F.col("cx"), F.transform("cols", lambda c: c["center"]))
    col_rank = F.row_number().over(Window.partitionBy(*keys).orderBy("cx", "box_idx"))
    placed = placed.withColumns({"row_index": row, "col_index": col, "col_rank": col_rank})
    members = F.size(F.filter(n_after(F.col("cols")), lambda e: e < F.col("col_rank")))
    placed = placed.withColumn("col_member", members)
    extent = placed.groupBy(*keys, F.col("col_member").alias("col_index")).agg(F.min("bbox.x0").alias("min_x0"), F.max("bbox.x1").alias("max_x1"))
    lines = placed.groupBy(*keys, "row_index").agg(F.min("bbox.y0").alias("min_y0"), F.max("bbox.y1").alias("max_y1"), F.first("width").alias("width"), F.first("height").alias("height"))
    cells = placed.groupBy(*keys, "row_index", "col_index").agg(F.max_by("bbox", F.struct("cy", "box_idx")).alias("box"))
    size = dims.select(*keys, F.size("rows").alias("n_rows"), F.size("cols").alias("n_cols"))
    dense = densify(cells, size, keys, mode).join(extent, [*keys, "col_index"]).join(lines, [*keys, "row_index"])
    pad = lambda s: F.greatest(F.lit(2), F.floor(0.01 * s))
    x0 = F.when(F.col("is_filler"), F.col("min_x0")).otherwise(F.greatest(F.col("min_x0"), F.col("box.x0") - pad(w)))
    x1 = F.when(F.col("is_filler"), F.col("max_x1")).otherwise(F.least(F.col("max_x1"), F.col("box.x1") + pad(w)))
    y0, y1 = F.greatest(F.lit(0.0), F.col("min_y0") - pad(h)), F.least(h, F.col("max_y1") + pad(h))
    dense = dense.select(*keys, "row_index", "col_index", G.bbox(x0, y0, x1, y1).alias("bbox"), "is_filler", "structure_source", "structure_confidence")
    note = F.when(F.bool_or("is_filler"), "ragged_columns")
    grids = dense.groupBy(*keys).agg(
        (F.max("row_index") + 1).alias("n_rows"),
        (F.max("col_index") + 1).alias("n_cols"),
        F.array_compact(F.array(F.lit("partial_borders"), note)).alias("irregularities"),
        (F.count_if(~F.col("is_filler")) / F.count(F.lit(1))).alias("structure_confidence"),
    )
    return dense, grids


def span_hints(cells: DataFrame, hints: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of ``hints(keys, row_index, col_index, row_span, col_span)`` on the cells they name, if both are positive."""
    at = [*keys, "row_index", "col_index"]
    good = hints.filter("row_span > 0 and col_span > 0").select(*at, F.col("row_span").alias("_rs"), F.col("col_span").alias("_cs"))
    out = cells.join(good, at, "left")
    rs = F.col("row_span") if "row_span" in cells.columns else F.lit(1)
    cs = F.col("col_span") if "col_span" in cells.columns else F.lit(1)
    return out.withColumns({"row_span": F.coalesce("_rs", rs), "col_span": F.coalesce("_cs", cs)}).drop("_rs", "_cs")


def first_available(grids: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Cells by strategy in order of preference -> those of the first strategy that has any, for each table, with ``strategy``."""
    all_ = None
    for rank, (name, cells) in enumerate(grids.items()):
        x = cells.withColumns({"strategy": F.lit(name), "_rank": F.lit(rank)})
        all_ = x if all_ is None else all_.unionByName(x, allowMissingColumns=True)
    best = all_.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return all_.join(best, [*keys, "_rank"]).drop("_rank")
