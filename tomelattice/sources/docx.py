"""DOCX files as Markdown, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BULLETS = "•●○◆◇"
#: Headings and indents at most, twentieths of a point to an indent.
MOST_HEADING, MOST_INDENT, INDENT = 6, 6, 720


def _val(element, *path: str) -> str | None:
    for name in path:
        element = element.find(_W + name) if element is not None else None
    return element.get(_W + "val") if element is not None else None


class _Document:
    def __init__(self, data: bytes) -> None:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            read = lambda n: ElementTree.fromstring(z.read(n)) if n in names else None
            self.body = read("word/document.xml").find(_W + "body")
            styles, numbering = read("word/styles.xml"), read("word/numbering.xml")
        self.styles = {s.get(_W + "styleId"): _val(s, "name") or "" for s in styles.iter(_W + "style")} if styles is not None else {}
        self.formats: dict[tuple[str, str], str] = {}
        if numbering is not None:
            of = {a.get(_W + "abstractNumId"): {v.get(_W + "ilvl"): _val(v, "numFmt") for v in a.iter(_W + "lvl")} for a in numbering.iter(_W + "abstractNum")}
            for n in numbering.iter(_W + "num"):
                for level, fmt in of.get(_val(n, "abstractNumId"), {}).items():
                    self.formats[n.get(_W + "numId"), level] = fmt or ""

    def heading(self, style: str | None) -> int:
        for name in (style, self.styles.get(style or "")):
            low = (name or "").lower()
            if "heading" in low or "标题" in low:
                digits = "".join(re.findall(r"\d", low))
                return min(int(digits or 1), MOST_HEADING)
        return 0


def _text(paragraph) -> str:
    return "".join(t.text or "" if t.tag == _W + "t" else "\t" if t.tag == _W + "tab" else "\n" for t in paragraph.iter() if t.tag in (_W + "t", _W + "tab", _W + "br"))


def _on(run, name: str) -> bool:
    mark = run.find(f"{_W}rPr/{_W}{name}")
    return mark is not None and mark.get(_W + "val", "true") not in ("0", "false", "off")


def _runs(paragraph) -> str:
    out = []
    for run in paragraph.iter(_W + "r"):
        text = "".join(t.text or "" for t in run.findall(_W + "t"))
        stars = "*" * (2 * _on(run, "b") + _on(run, "i")) if text else ""
        out.append(stars + text + stars)
    return "".join(out)


def _paragraph(doc: _Document, p) -> str:
    text = _text(p)
    if not text.strip():
        return ""
    level = doc.heading(_val(p, "pPr", "pStyle"))
    if level:
        return f"{'#' * level} {text.strip()}"
    number, depth = _val(p, "pPr", "numPr", "numId"), _val(p, "pPr", "numPr", "ilvl") or "0"
    fmt = doc.formats.get((number, depth)) if number else None
    prefix = None
    if fmt is not None:
        prefix = f"{int(depth) + 1}. " if fmt.lower() == "decimal" else "- "
    elif text.strip()[0] in _BULLETS:
        prefix = "- "
    if prefix is None:
        return _runs(p)
    indent = p.find(f"{_W}pPr/{_W}ind")
    left = int(indent.get(_W + "left") or 0) if indent is not None else 0
    return "  " * min(left // INDENT, MOST_INDENT) + prefix + _runs(p)


def _table(t) -> str:
    rows = [[" ".join(x for p in c.iter(_W + "p") if (x := _text(p).strip())).replace("|", "\\|") for c in r.findall(_W + "tc")] for r in t.findall(_W + "tr")]
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def to_markdown(data: bytes) -> str:
    """Headings, lists, bold and italic runs and tables of a DOCX file."""
    doc = _Document(data)
    out = []
    for element in doc.body:
        block = _paragraph(doc, element) if element.tag == _W + "p" else _table(element) if element.tag == _W + "tbl" else ""
        if block:
            out.append(block)
    return "\n".join(out).strip()
