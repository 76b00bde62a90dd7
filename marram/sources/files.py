"""Files as corpora: listing, filters by size, extension and ignore rules, text of documents, logs, DOCX and XLSX."""

from __future__ import annotations

import html
import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions import text as T

# Extensions that are searched, that are documents, names that are text, and the language of each extension.
SEARCHED = ".ts .tsx .js .jsx .mjs .cjs .py .go .java .cs .rs .rb .php .kt .swift .scala .json .yaml .yml .toml .md .txt .log .css .scss .less .html .astro".split()
DOCUMENTS = ".md .mdx .txt .log .html .htm .css .docx .xlsx .pdf .csv .json .ndjson".split()
TEXT_NAMES = ["README", "LICENSE", "NOTICE", "CHANGELOG", "CODEOWNERS", ".gitignore", ".editorconfig"]
SYMBOL_EXTENSIONS = ".ts .tsx .js .jsx .py".split()
LANGUAGES = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "tsx", ".jsx": "tsx", ".mjs": "tsx", ".cjs": "tsx", ".py": "python", ".go": "go",
    ".rs": "rust", ".java": "java", ".c": "c", ".cpp": "cpp", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".css": "css", ".scss": "scss",
}
EXCLUDED = ["**/node_modules/**", "**/.git/**", "**/dist/**", "**/coverage/**", "**/*.test.*", "**/*.spec.*"]
MOST_BYTES, HEAD_BYTES, TAIL_BYTES, LARGE_BYTES = 512 * 1024, 600_000, 300_000, 2_000_000


def list_files(spark: SparkSession, root: str, *, depth: int | None = None, most: int | None = None) -> DataFrame:
    """(path relative to root, mtime, size) of all files below root; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    base = re.sub("^[a-z]+:/*", "/", root).rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base), "")
    d = d.select(rel.alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))
    if depth is not None:
        d = d.where(F.size(F.split("path", "/")) <= depth)
    return d.orderBy("path").limit(most) if most else d


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size, content) of all files below root."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub("^[a-z]+:/*", "/", root).rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base), "")
    return d.select(rel.alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def searchable(files: DataFrame, known: DataFrame | None = None, *, extensions: list[str] = SEARCHED, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files to index: by extension and size, and not of the mtime that `known` (path, mtime) has."""
    out = files.where(T.extension(F.col("path")).isin(extensions) & (F.col("size") <= most_bytes))
    return out if known is None else out.join(known.select("path", "mtime"), ["path", "mtime"], "left_anti")


def is_document(path: Column) -> Column:
    return T.extension(path).isin(DOCUMENTS) | T.basename(path).isin(TEXT_NAMES)


def language(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """The language of a file's extension; a map literal, so no join."""
    table = F.create_map(*(F.lit(x) for pair in (LANGUAGES | (overrides or {})).items() for x in pair))
    return F.try_element_at(table, T.extension(path))


def sampled_text(content: Column) -> Column:
    """The text of a file; of one over 2 MB its head and tail around a marker line."""
    n = F.octet_length(content)
    head, tail = F.substring(content, 1, HEAD_BYTES), F.substring(content, -TAIL_BYTES, TAIL_BYTES)
    cut = F.concat(F.decode(head, "UTF-8"), F.lit("\n[[... omitted ...]]\n"), F.decode(tail, "UTF-8"))
    return F.when(n > LARGE_BYTES, cut).otherwise(F.decode(content, "UTF-8"))


def ignore_rules(texts: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    """(regular expression, whether it brings back) for the lines of ignore files given as (directory, text), in order."""
    rules = []
    for directory, text in texts:
        for line in text.splitlines():
            line = line.strip()
            if line and not line.startswith("#"):
                keep, line = line.startswith("!"), line.lstrip("!")
                anchored = "/" in line.rstrip("/")
                body = T.glob_regex(line.strip("/") + "/**", zero_dirs=True)[1:]
                prefix = re.escape(directory.strip("/") + "/") if directory.strip("/") else ""
                rules.append((f"^{prefix}{'' if anchored else '(.*/)?'}{body}", keep))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches a path ignores it."""
    out = F.lit(False)
    for pattern, keep in rules:
        out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


# ---------------------------------------------------------------- office files, by the standard library

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs by line; headings with # by their style, list items with a dash, images as [image: alt]."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    out = []
    for p in body.iter(f"{_W}p"):
        parts = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag == f"{_W}tab":
                parts.append("\t")
            elif e.tag.endswith("}docPr"):
                parts.append(f"[image: {e.get('descr') or e.get('name') or ''}]")
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"[Hh]eading ?([1-6])", style.get(f"{_W}val", "") if style is not None else "")
        item = p.find(f"{_W}pPr/{_W}numPr") is not None
        out.append(("#" * int(level[1]) + " " if level else "- " if item else "") + "".join(parts))
    return "\n".join(out)


def xlsx_text(content: bytes, sheets: int = 5, rows: int = 200, columns: int = 30) -> str:
    """[Sheet: name], the header, and Row i: header=value pairs of cells that are not empty."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    names = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    out = []
    for k, name in enumerate(names[:sheets], 1):
        out.append(f"[Sheet: {name}]")
        table = []
        for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for c in r.iter(f"{_S}c"):
                at = 0
                for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                    at = at * 26 + ord(ch) - 64
                v = c.find(f"{_S}v")
                value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                cells[at] = shared[int(value)] if c.get("t") == "s" and value else value
            table.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
        if table:
            header = [x.strip() or f"Col{i}" for i, x in enumerate(table[0], 1)][:columns]
            out.append("Header: " + " | ".join(header))
            for i, r in enumerate(table[1 : rows + 1], 1):
                out.append(f"Row {i}: " + " | ".join(f"{h}={v.strip()}" for h, v in zip(header, r) if v.strip()))
    return "\n".join(out)


def document_text(files: DataFrame) -> DataFrame:
    """(path, kind, text, warning) of (path, content): text files in built-ins, DOCX and XLSX in batches of one file; a file that
    cannot be parsed has empty text and a warning, and PDF, for which there is no parser here, always."""
    ext = T.extension(F.col("path"))
    office = ext.isin(".docx", ".xlsx", ".pdf")
    kind = F.when(ext.isin(".md"), "markdown").when(ext == ".mdx", "mdx").when(ext.isin(".html", ".htm"), "html").when(ext == ".css", "css").otherwise("text")
    plain = files.where(~office).select("path", kind.alias("kind"), sampled_text(F.col("content")).alias("text"), F.lit(None).cast("string").alias("warning"))

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    if path.lower().endswith(".docx"):
                        rows.append((path, "docx", docx_text(content), None))
                    elif path.lower().endswith(".xlsx"):
                        rows.append((path, "xlsx", xlsx_text(content), None))
                    else:
                        rows.append((path, "pdf", "", "pdf_parser_missing"))
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, "unknown", "", f"parse_failed: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "warning"])

    return plain.unionByName(files.where(office).select("path", "content").mapInPandas(parse, "path string, kind string, text string, warning string"))


def mdx_text(text: Column) -> Column:
    """{x} as [[mdx:x]]; self-closing components as [[component:Name]]."""
    t = F.regexp_replace(text, r"<([A-Z][A-Za-z0-9.]*)[^>]*/>", "[[component:$1]]")
    return F.regexp_replace(t, r"\{\s*([^{}\n]+?)\s*\}", "[[mdx:$1]]")


def unescaped(text: str) -> str:
    return html.unescape(text)
