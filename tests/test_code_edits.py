"""Code, edits, sources and streams on small inputs."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from marram.operators import code as C
from marram.operators import edits as E
from marram.operators import tables as U
from marram.sources import files as S
from marram.streaming import changes as X

TS = """import def, { a as b, type T } from './util';
import * as ns from "../ns";
const { x: y } = require('lib');
export class Cart extends Base<Item> implements Priced, Named {
  total(items: Item[]): number {
    const sum = add(items.length, 1);
    return ns.round(sum);
  }
}
export interface Shape<T extends Entity> extends Base { }
export type Result = Customer | PremiumCustomer;
export const run = async (c) => {
  await c.save(1, [2, 3]);
  new Cart();
};
function helper() { return run(); }
export { helper as h };
export * from './all';
"""


def test_typescript():
    s = {(x["name"], x["type"], x["container"], x["start_line"], x["end_line"], x["exported"]) for x in C.symbols_of("a.ts", TS)}
    assert {("Cart", "class", None, 4, 9, True), ("total", "method", "Cart", 5, 8, False), ("Shape", "interface", None, 10, 10, True), ("Result", "type_alias", None, 11, 11, True), ("run", "function", None, 12, 15, True), ("helper", "function", None, 16, 16, False)} <= s
    calls = {(c["callee"], c["object"], c["call_type"], c["line"], c["n_args"], c["awaited"]) for c in C.calls_of(TS)}
    assert {("add", None, "direct", 6, 2, False), ("round", "ns", "method", 7, 1, False), ("save", "c", "method", 13, 2, True), ("Cart", None, "constructor", 14, 0, False), ("run", None, "direct", 16, 0, False)} <= calls
    imports = {(i["specifier"], i["local"], i["imported"]) for i in C.imports_of(TS)}
    assert imports == {("./util", "def", "default"), ("./util", "b", "a"), ("./util", "T", "T"), ("../ns", "ns", "*"), ("lib", "y", "x")}
    exports = {(e["name"], e["kind"]) for e in C.exports_of("a.ts", TS)}
    assert exports == {("Cart", "declaration"), ("Shape", "declaration"), ("Result", "declaration"), ("run", "declaration"), ("h", "named"), ("*", "star")}
    assert C.type_relations("class Cart extends Base<Item> implements Priced, Named {", "class") == [("Base", "extends"), ("Priced", "implements"), ("Named", "implements")]
    assert C.type_relations("type Result = Customer | PremiumCustomer", "type_alias") == [("Customer", "alias"), ("PremiumCustomer", "alias")]
    assert ("Entity", "constraint") in C.type_relations("interface Shape<T extends Entity> extends Base {", "interface")
    assert "return ns.round" not in C.skeleton_of("a.ts", TS) and "total(items" in C.skeleton_of("a.ts", TS)


def test_python(spark):
    text = "class A:\n    def f(self, x):\n        y = g(x)\n        return y\n\nLIMIT = 3\n"
    assert [(s["name"], s["type"], s["container"], s["end_line"]) for s in C.symbols_of("a.py", text)] == [("A", "class", None, 4), ("f", "method", "A", 4), ("LIMIT", "variable", None, 6)]
    assert C.symbols_of("a.py", "def (") == []
    assert [s["step"] for s in C.data_flow("const total = 1;\ntotal = 2;\nlogValue(total);\nreturn total;", "total")] == ["definition", "assignment", "call_argument", "return"]
    files = spark.createDataFrame([("a.py", text), ("a.ts", TS), ("b.ts", None)], "path string, text string")
    assert {r["name"] for r in C.symbols(files).collect()} >= {"A", "f", "Cart"}
    assert ("total", "add") in {(r["caller"], r["callee"]) for r in C.calls(files).collect()}
    assert C.imports(files).count() == 5 and C.exports(files).where("kind = 'star'").count() == 1
    assert [r["path"] for r in C.declared_anywhere(files, "Cart").collect()] == ["a.ts"]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_diffs():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(9))] for _ in range(2))
        for diff in (E.line_diff, E.patience_diff):
            d = diff(a, b)
            assert [x for k, x in d if k != "insert"] == a and [x for k, x in d if k != "delete"] == b
        assert sum(k == "equal" for k, _ in E.line_diff(a, b)) == lcs(a, b)
    assert E.longest_increasing([3, 1, 2, 5, 4, 6]) in ([1, 2, 4, 5], [1, 2, 3, 5])


def test_edits(spark):
    d = spark.createDataFrame([("a\tb  \r\n  c", "a\tb\n  c"), ("x", "y")], ["text", "target"])
    assert [r["l"] for r in d.select(E.match_level(F.col("text"), F.col("target")).alias("l")).collect()] == ["trailing", None]
    lines = spark.createDataFrame([(1, 1, "const total = sum(items);"), (1, 2, "something else entirely")], ["doc_id", "line", "text"])
    assert [r["line"] for r in E.fuzzy_lines(lines, "const totl = sum(item);").collect()] == [1]
    e = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("a", 6, 7)], ["path", "start", "end"])
    assert [(r["start"], r["end"]) for r in E.overlapping_edits(e).collect()] == [(3, 6)]
    old = spark.createDataFrame([("function", "f", "a b c d e"), ("function", "g", "x y z"), ("class", "K", "q")], ["type", "name", "body"])
    new = spark.createDataFrame([("function", "f2", "a b c d e"), ("function", "g", "x y w"), ("class", "L", "r s")], ["type", "name", "body"])
    got = {(r["name"], r["new_name"], r["change"]) for r in E.semantic_diff(old, new).collect()}
    assert got == {("f", "f2", "rename"), ("g", None, "modify"), ("K", None, "remove"), ("L", None, "add")}
    log = spark.createDataFrame([("p", 1, "do"), ("p", 2, "do"), ("p", 3, "undo"), ("p", 4, "do"), ("p", 5, "do"), ("p", 6, "undo")], ["path", "seq", "action"])
    assert [(r["seq"], r["place"]) for r in E.history(log).orderBy("place").collect()] == [(4, 1), (1, 2)]
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nc\nd"), (2, None, "x")], "k long, o string, n string")
    assert {(r["k"], r["added"], r["removed"], r["unchanged"]) for r in E.diff_summary(pairs, "k", "o", "n").collect()} == {(1, 1, 1, 2), (2, 1, 1, 0)}


def test_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# A")
    (tmp_path / "big.bin").write_bytes(b"x" * 10)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(b.getvalue())
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}"><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "t.xlsx").write_bytes(b.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    files = S.read_files(spark, str(tmp_path))
    assert {r["path"] for r in S.list_files(spark, str(tmp_path), depth=1).collect()} == {"big.bin", "d.docx", "t.xlsx", "bad.docx"}
    assert [r["path"] for r in S.searchable(files).collect()] == ["docs/a.md"]
    got = {r["path"]: (r["kind"], r["text"]) for r in S.document_text(files.where(S.is_document(F.col("path")))).collect()}
    assert got["docs/a.md"] == ("markdown", "# A") and got["d.docx"] == ("docx", "## Title\nBody") and got["bad.docx"][0] == "unknown"
    assert got["t.xlsx"][1] == "[Sheet: S1]\nHeader: name | n\nRow 1: name=x | n=5"
    rules = S.ignore_rules([("", "*.log\n!keep.log\n/build\n"), ("sub", "tmp")])
    p = spark.createDataFrame([(x,) for x in ("a/x.log", "keep.log", "build/o", "src/build/o", "sub/a/tmp/x", "tmp/x")], ["path"])
    assert {r["path"] for r in p.where(S.ignored(F.col("path"), rules)).collect()} == {"a/x.log", "build/o", "sub/a/tmp/x"}
    assert p.select(S.language(F.lit("a/b.py")).alias("l")).first()["l"] == "python"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src, n = str(tmp_path / "src"), events.count()
    events.repartition(4).write.parquet(src)
    changes = X.read_changes(spark, src, events.schema, files=1)
    X.keep_state(changes, str(tmp_path / "state"), str(tmp_path / "cp1")).awaitTermination()
    batches = max(int(p.name[2:]) for p in (tmp_path / "state").iterdir() if p.name.startswith("n="))
    got = spark.read.parquet(str(tmp_path / f"state/n={batches}"))
    want = X.latest_state(X.from_events(events.withColumn("ts", F.col("ts").cast("timestamp"))))
    assert batches > 0 and got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    q = X.window_counts(X.read_changes(spark, src, events.schema, files=2), "1 hour", "windows", str(tmp_path / "cp2"))
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == n


def test_tables(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], ["k", "v", "t"])
    b = spark.createDataFrame([(2, "z", 2), (3, "w", 1)], ["k", "v", "t"])
    assert {tuple(r) for r in U.upsert(a, b, ["k"], ["t"]).collect()} == {(1, "x", 1), (2, "z", 2), (3, "w", 1)}
    assert {tuple(r) for r in U.replace_by_key(a, b, ["k"]).collect()} == {(1, "x", 1), (2, "z", 2), (3, "w", 1)}
    p = spark.createDataFrame([("src/a",), ("src",), ("srcs/b",)], ["path"])
    assert [r["path"] for r in U.delete_path(p, "src").collect()] == ["srcs/b"]
