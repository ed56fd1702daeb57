"""Workbooks on the standard library: a sheet per table, cells coloured by confidence band, notes on low ones."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

# Fill colours of the bands.
FILLS = {"header": "D9E1F2", "high": "C6EFCE", "medium": "FFEB9C", "low": "FFC7CE"}
_STYLE = {None: 0, **{k: i + 1 for i, k in enumerate(FILLS)}}
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
LEGEND = (("high", "confidence of 0.85 or more"), ("medium", "confidence of 0.70 or more"), ("low", "confidence below 0.70, check"))


@dataclass
class Sheet:
    name: str
    columns: Sequence[str]
    rows: Sequence[Sequence[str | None]]
    #: The confidence of each cell, where colours are wanted.
    confidences: Sequence[Sequence[float | None]] | None = None


def band(confidence: float) -> str:
    return "high" if confidence >= 0.85 else "medium" if confidence >= 0.70 else "low"


def short_name(name: str) -> str:
    return name[:28] + "..." if len(name) > 31 else name


def _unique(names: Iterable[str]) -> list[str]:
    """Names without the marks that a workbook forbids, none twice."""
    out: list[str] = []
    for name in names:
        base = short_name("".join("_" if c in "[]:*?/\\" else c for c in name) or "Sheet")
        new, k = base, 2
        while new.lower() in {x.lower() for x in out}:
            new, k = f"{base[: 30 - len(str(k))]}_{k}", k + 1
        out.append(new)
    return out


def _ref(row: int, col: int) -> str:
    letters, col = "", col + 1
    while col:
        col, k = divmod(col - 1, 26)
        letters = chr(65 + k) + letters
    return f"{letters}{row + 1}"


def _clean(text: str) -> str:
    return escape("".join(c for c in text if c >= " " or c in "\t\n\r"))


def _cell(row: int, col: int, value: str | None, style: str | None) -> str:
    s = f' s="{_STYLE[style]}"' if style else ""
    if value is None:
        return f'<c r="{_ref(row, col)}"{s}/>' if style else ""
    return f'<c r="{_ref(row, col)}"{s} t="inlineStr"><is><t xml:space="preserve">{_clean(str(value))}</t></is></c>'


def _sheet(sheet: Sheet, notes: bool) -> str:
    lines = [[(v, "header") for v in sheet.columns]]
    for i, row in enumerate(sheet.rows):
        c = sheet.confidences[i] if sheet.confidences and i < len(sheet.confidences) else ()
        lines.append([(v, band(c[j]) if j < len(c) and c[j] is not None else None) for j, v in enumerate(row)])
    if sheet.confidences:
        lines += [[]] + [[(text, name)] for name, text in LEGEND]
    body = "".join(f'<row r="{r + 1}">{"".join(_cell(r, c, v, s) for c, (v, s) in enumerate(line))}</row>' for r, line in enumerate(lines))
    legacy = f'<legacyDrawing xmlns:r="{_REL}" r:id="rId2"/>' if notes else ""
    return f"{_HEAD}<worksheet {_NS}><sheetData>{body}</sheetData>{legacy}</worksheet>"


def _low(sheet: Sheet) -> list[tuple[int, int, float]]:
    return [(r, c, v) for r, row in enumerate(sheet.confidences or ()) for c, v in enumerate(row) if v is not None and band(v) == "low"]


def _comments(low: list[tuple[int, int, float]]) -> str:
    items = "".join(f'<comment ref="{_ref(r + 1, c)}" authorId="0"><text><t>Low confidence: {v:.2f}</t></text></comment>' for r, c, v in low)
    return f"{_HEAD}<comments {_NS}><authors><author>gridspark</author></authors><commentList>{items}</commentList></comments>"


def _drawing(low: list[tuple[int, int, float]]) -> str:
    shapes = "".join(
        f'<v:shape id="n{i}" type="#n" style="visibility:hidden"><v:textbox/><x:ClientData ObjectType="Note"><x:Row>{r + 1}</x:Row><x:Column>{c}</x:Column></x:ClientData></v:shape>'
        for i, (r, c, _) in enumerate(low)
    )
    spaces = 'xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:x="urn:schemas-microsoft-com:office:excel"'
    return f'<xml {spaces}><v:shapetype id="n" coordsize="21600,21600" o:spt="202" path="m,l,21600r21600,l21600,xe"/>{shapes}</xml>'


def _styles() -> str:
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in FILLS.values())
    formats = "".join(f'<xf numFmtId="0" fontId="{int(k == "header")}" fillId="{i + 2}" borderId="0" applyFill="1"/>' for i, k in enumerate(FILLS))
    return (
        f'{_HEAD}<styleSheet {_NS}><fonts count="2"><font/><font><b/></font></fonts><fills count="{len(FILLS) + 2}"><fill><patternFill patternType="none"/></fill>'
        f'<fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        f'<cellXfs count="{len(FILLS) + 1}"><xf/>{formats}</cellXfs></styleSheet>'
    )


def _relations(items: list[tuple[str, str]]) -> str:
    rows = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(items, 1))
    return f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">{rows}</Relationships>'


def write(path: str | Path, sheets: list[Sheet]) -> None:
    """A workbook of ``sheets``, or of one that says that no table was found."""
    sheets = sheets or [Sheet("NoTablesFound", ["message"], [["No tables were found"]])]
    names = _unique(s.name for s in sheets)
    low = [_low(s) for s in sheets]
    n = range(1, len(sheets) + 1)
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = [("/xl/workbook.xml", f"{main}.sheet.main+xml"), ("/xl/styles.xml", f"{main}.styles+xml")]
    parts += [(f"/xl/worksheets/sheet{i}.xml", f"{main}.worksheet+xml") for i in n]
    parts += [(f"/xl/comments{i}.xml", f"{main}.comments+xml") for i in n if low[i - 1]]
    types = "".join(f'<Override PartName="{p}" ContentType="{t}"/>' for p, t in parts)
    defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="vml" ContentType="application/vnd.openxmlformats-officedocument.vmlDrawing"/>'
    book = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, names, strict=True))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PKG}/content-types">{defaults}{types}</Types>')
        z.writestr("_rels/.rels", _relations([("officeDocument", "xl/workbook.xml")]))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook {_NS} xmlns:r="{_REL}"><sheets>{book}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", _relations([*(("worksheet", f"worksheets/sheet{i}.xml") for i in n), ("styles", "styles.xml")]))
        z.writestr("xl/styles.xml", _styles())
        for i, sheet in zip(n, sheets, strict=True):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(sheet, bool(low[i - 1])))
            if low[i - 1]:
                z.writestr(f"xl/worksheets/_rels/sheet{i}.xml.rels", _relations([("comments", f"../comments{i}.xml"), ("vmlDrawing", f"../drawings/vml{i}.vml")]))
                z.writestr(f"xl/comments{i}.xml", _comments(low[i - 1]))
                z.writestr(f"xl/drawings/vml{i}.vml", _drawing(low[i - 1]))
