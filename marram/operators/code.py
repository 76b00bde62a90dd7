"""Symbols, imports, exports, calls and type relations from source text: Python by its own parser, TypeScript and JavaScript by
line patterns and brace matching. Pure functions over one text, applied in batches."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DEFINE = re.compile(
    r"^(?P<export>export\s+(?:default\s+)?)?(?:abstract\s+|async\s+|declare\s+)*(?:(?P<kind>class|function\*?|interface|enum)\s+(?P<name>[A-Za-z_$][\w$]*)|type\s+(?P<alias>[A-Za-z_$][\w$]*)[^=]*=|(?:const|let|var)\s+(?P<var>[A-Za-z_$][\w$]*))",
)
_METHOD = re.compile(r"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{;]+)?\{")
_NO_METHOD = {"if", "for", "while", "switch", "catch", "return", "function", "constructor_"}
_CALL = re.compile(r"(?P<await>await\s+)?(?P<new>new\s+)?(?:(?P<object>[A-Za-z_$][\w$.]*)\.)?(?P<callee>[A-Za-z_$][\w$]*)\s*\(")
_IMPORT = re.compile(r"import\s+(?:(?P<what>[^'\";]+?)\s+from\s+)?['\"](?P<source>[^'\"]+)['\"]|(?:const|let|var)\s+(?P<bound>\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*['\"](?P<required>[^'\"]+)['\"]\s*\)")
_EXPORT = re.compile(r"export\s+(?:(?P<star>\*)(?:\s+as\s+[\w$]+)?\s+from\s+['\"](?P<from>[^'\"]+)['\"]|\{(?P<names>[^}]*)\}(?:\s+from\s+['\"](?P<from2>[^'\"]+)['\"])?|default\b)")
_TYPE_STOP = {"string", "number", "boolean", "any", "unknown", "void", "never", "null", "undefined", "object", "symbol", "bigint", "extends", "implements", "keyof", "typeof", "readonly", "infer", "in"}


def _python_symbols(text: str) -> list[dict]:
    out: list[dict] = []

    def visit(node, container):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if container else "function"
                out.append({"name": n.name, "type": kind, "container": container, "start_line": n.lineno, "end_line": n.end_lineno, "exported": not n.name.startswith("_")})
                visit(n, n.name if kind == "class" else container)
            elif isinstance(n, ast.Assign | ast.AnnAssign) and container is None and isinstance(node, ast.Module):
                targets = n.targets if isinstance(n, ast.Assign) else [n.target]
                out.extend({"name": t.id, "type": "variable", "container": None, "start_line": n.lineno, "end_line": n.end_lineno, "exported": True} for t in targets if isinstance(t, ast.Name))

    visit(ast.parse(text), None)
    return out


def _block_end(lines: list[str], start: int) -> int:
    """The line, from 0, on which the braces opened from `start` on close; the line itself if none opens before a semicolon."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for c in re.sub(r"//.*$|'[^']*'|\"[^\"]*\"|`[^`]*`", "", lines[i]):
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
            if opened and depth == 0:
                return i
        if not opened and lines[i].rstrip().endswith(";"):
            return i
    return len(lines) - 1 if opened else start


def symbols_of(path: str, text: str) -> list[dict]:
    """name, type, container, start_line, end_line, exported of each definition; none where Python does not parse."""
    if path.endswith(".py"):
        try:
            return _python_symbols(text)
        except (SyntaxError, ValueError):
            return []
    lines, out, outer = text.split("\n"), [], None
    for i, line in enumerate(lines):
        if m := _DEFINE.match(line):
            kind = {"function*": "function"}.get(m["kind"], m["kind"]) or ("type_alias" if m["alias"] else "variable")
            end = _block_end(lines, i)
            if kind == "variable" and re.search(r"=\s*(async\s*)?(\([^)]*\)|[\w$]+)\s*(:[^=]+)?=>|=\s*(async\s+)?function\b", line):
                kind = "function"
            out.append({"name": m["name"] or m["alias"] or m["var"], "type": kind, "container": None, "start_line": i + 1, "end_line": end + 1, "exported": bool(m["export"])})
            outer = (out[-1]["name"], end) if kind == "class" else outer
        elif outer and i <= outer[1] and (m := _METHOD.match(line)) and m["name"] not in _NO_METHOD:
            out.append({"name": m["name"], "type": "method", "container": outer[0], "start_line": i + 1, "end_line": _block_end(lines, i) + 1, "exported": False})
    return out


def calls_of(text: str) -> list[dict]:
    """callee, object, call_type (direct, method, constructor), line, n_args, awaited of each call."""
    out = []
    clean = re.sub(r"//[^\n]*|'[^'\n]*'|\"[^\"\n]*\"", lambda m: " " * len(m[0]), text)
    for m in _CALL.finditer(clean):
        if m["callee"] in {"if", "for", "while", "switch", "catch", "function", "return", "def", "class", "elif", "with", "and", "or", "not", "in"} or re.search(r"(?:function\*?|def|class)\s+$", clean[: m.start("callee")][-16:]):
            continue
        depth, n, seen, i = 1, 0, False, m.end()
        while i < len(clean) and depth:
            c = clean[i]
            depth += (c in "([{") - (c in ")]}")
            seen |= depth > 0 and not c.isspace()
            n += c == "," and depth == 1
            i += 1
        if re.match(r"\s*(:[^{;=]+)?\{", clean[i:]) and not m["new"] and not m["object"] and re.match(r"^\s+", clean[clean.rfind("\n", 0, m.start()) + 1 : m.start("callee")] or "x") and not m["await"]:
            continue  # a method's own definition
        out.append({"callee": m["callee"], "object": m["object"], "call_type": "constructor" if m["new"] else "method" if m["object"] else "direct", "line": text.count("\n", 0, m.start()) + 1, "n_args": n + seen, "awaited": bool(m["await"])})
    return out


def imports_of(text: str) -> list[dict]:
    """specifier, local, imported (default, * or a name), line, type_only of each binding; a bare import binds nothing."""
    out = []
    for m in _IMPORT.finditer(text):
        line, source = text.count("\n", 0, m.start()) + 1, m["source"] or m["required"]
        what = (m["what"] or m["bound"] or "").strip()
        type_only = what.startswith("type ")
        what = what.removeprefix("type ")
        bound = []
        if b := re.search(r"\{([^}]*)\}", what):
            for x in filter(None, (p.strip() for p in b[1].split(","))):
                name, _, local = re.sub(r"\s+as\s+|\s*:\s*", "\0", x.removeprefix("type ")).partition("\0")
                bound.append((local or name, name))
            what = what.replace(b[0], "")
        for x in filter(None, (p.strip() for p in what.split(","))):
            bound.append((x.removeprefix("* as ").strip(), "*" if x.startswith("*") or m["required"] else "default"))
        out += [{"specifier": source, "local": a, "imported": n, "line": line, "type_only": type_only} for a, n in bound or [(None, None)]]
    return out


def exports_of(path: str, text: str) -> list[dict]:
    """name, kind (declaration, named, re-export, star, default) and source of each export."""
    out = [{"name": s["name"], "kind": "declaration", "source": None} for s in symbols_of(path, text) if s["exported"]]
    for m in _EXPORT.finditer(text):
        if m["star"]:
            out.append({"name": "*", "kind": "star", "source": m["from"]})
        elif m["names"] is not None:
            for x in filter(None, (p.strip() for p in m["names"].split(","))):
                out.append({"name": re.split(r"\s+as\s+", x)[-1], "kind": "re-export" if m["from2"] else "named", "source": m["from2"]})
        else:
            out.append({"name": "default", "kind": "default", "source": None})
    return out


def type_relations(signature: str, kind: str) -> list[tuple[str, str]]:
    """(target, relation) of a type's signature: extends, implements, alias, constraint."""
    out = []
    names = lambda s: [x for x in re.findall(r"[A-Za-z_][\w.$]*", re.sub(r"<[^>]*>", "", s)) if x not in _TYPE_STOP]
    bare = re.sub(r"^([^<{]*)<[^>]*>", r"\1", signature)
    for word in ("extends", "implements") if kind == "class" else ("extends",) if kind == "interface" else ():
        if m := re.search(rf"\b{word}\s+([^\n{{]+?)(?=\bimplements\b|\bextends\b|\{{|$)", bare):
            out += [(x, word) for x in names(m[1])]
    if kind == "type_alias" and (m := re.search(r"=\s*([^;]+)", signature)):
        out += [(x, "alias") for x in names(m[1])]
    if m := re.search(r"<([^>]*)>", signature.split("{")[0].split("=")[0]):
        out += [(x, "constraint") for x in re.findall(r"extends\s+([A-Za-z_][\w.$]*)", m[1]) if x not in _TYPE_STOP]
    return out


def skeleton_of(path: str, text: str) -> str:
    """The text with the bodies of functions and methods folded."""
    lines, fold = text.split("\n"), {}
    for s in symbols_of(path, text):
        if s["type"] in {"function", "method"} and s["end_line"] > s["start_line"]:
            fold[s["start_line"]] = s["end_line"]
    out, i = [], 1
    while i <= len(lines):
        out.append(lines[i - 1])
        if i in fold:
            if path.endswith(".py"):
                out.append(re.match(r"\s*", lines[i - 1])[0] + "    ...")
                i = fold[i] + 1
                continue
            out[-1] += " /* ... */"
            i = fold[i]
            continue
        i += 1
    return "\n".join(out)


def identifiers(text: str, targets: set[str]) -> list[tuple[str, int]]:
    return [(m[0], text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"\b[A-Za-z_$][\w$]*\b", text) if m[0] in targets]


def data_flow(text: str, name: str, most: int = 10) -> list[dict]:
    """Ordered steps of a variable: definition, assignment, call_argument, return, reference; from its definition on."""
    steps = []
    for i, line in enumerate(text.split("\n"), 1):
        for m in re.finditer(rf"\b{re.escape(name)}\b", line):
            before, after = line[: m.start()], line[m.end() :]
            if re.search(r"\b(const|let|var)\s+$", before):
                kind = "definition"
            elif re.match(r"\s*[-+*/]?=(?!=)", after):
                kind = "assignment"
            elif re.search(r"\breturn\b[^;]*$", before):
                kind = "return"
            elif re.search(r"[\w$]\([^()]*$", before):
                kind = "call_argument" if not re.match(r"\s*(function|def)\b", line) else "parameter"
            else:
                kind = "reference"
            steps.append({"line": i, "column": m.start(), "step": kind})
    first = next((k for k, s in enumerate(steps) if s["step"] in {"definition", "parameter"}), 0)
    return steps[first : first + most]


def _mapped(files: DataFrame, of, fields: list[tuple[str, str]]) -> DataFrame:
    names = ["path", *(n for n, _ in fields)]

    def run(batches):
        for pdf in batches:
            rows = [{"path": p, **r} for p, t in zip(pdf["path"], pdf["text"]) for r in of(p, t or "")]
            yield pd.DataFrame(rows, columns=names).astype({n: "Int64" for n, t in fields if t == "long"})

    return files.select("path", "text").mapInPandas(run, "path string, " + ", ".join(f"{n} {t}" for n, t in fields))


def symbols(files: DataFrame) -> DataFrame:
    return _mapped(files, symbols_of, [("name", "string"), ("type", "string"), ("container", "string"), ("start_line", "long"), ("end_line", "long"), ("exported", "boolean")])


def calls(files: DataFrame) -> DataFrame:
    """With the innermost symbol that holds each call as caller."""

    def of(path, text):
        syms = [s for s in symbols_of(path, text) if s["type"] in {"function", "method"}]
        for c in calls_of(text):
            inside = [s for s in syms if s["start_line"] <= c["line"] <= s["end_line"]]
            yield {"caller": max(inside, key=lambda s: s["start_line"])["name"] if inside else None, **c}

    return _mapped(files, of, [("caller", "string"), ("callee", "string"), ("object", "string"), ("call_type", "string"), ("line", "long"), ("n_args", "long"), ("awaited", "boolean")])


def imports(files: DataFrame) -> DataFrame:
    return _mapped(files, lambda p, t: imports_of(t), [("specifier", "string"), ("local", "string"), ("imported", "string"), ("line", "long"), ("type_only", "boolean")])


def exports(files: DataFrame) -> DataFrame:
    return _mapped(files, exports_of, [("name", "string"), ("kind", "string"), ("source", "string")])


def declared_anywhere(files: DataFrame, name: str) -> DataFrame:
    """Paths whose text declares a name by one of the usual forms, for when no parser has it."""
    n = re.escape(name)
    forms = [rf"class\s+{n}\s*[{{<]", rf"function\s+{n}\s*[(<]", rf"(const|let)\s+{n}\s*=", rf"export\s+.*{n}", rf"interface\s+{n}\s*[{{<]", rf"type\s+{n}\s*="]
    return files.where(F.col("text").rlike("|".join(forms))).select("path")


def comments(files: DataFrame, least: int = 24, letters: int = 12) -> DataFrame:
    """(path, text) of block comments, docstrings and line comments that say something: long enough and no tool's pragma."""
    found = F.concat(
        F.regexp_extract_all("text", F.lit(r"/\*\*?([\s\S]*?)\*/"), F.lit(1)),
        F.regexp_extract_all("text", F.lit(r'"""([\s\S]*?)"""'), F.lit(1)),
        F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?://|#)\s?(.*)$"), F.lit(1)),
    )
    d = files.select("path", F.explode(found).alias("c")).select("path", F.trim(F.regexp_replace(F.regexp_replace("c", r"(?m)^\s*\*\s?", ""), r"\s+", " ")).alias("text"))
    return d.where((F.length("text") >= least) & (F.length(F.regexp_replace("text", "[^A-Za-z]", "")) >= letters) & ~F.col("text").rlike("(?i)eslint-disable|ts-ignore|prettier-ignore|noqa"))
