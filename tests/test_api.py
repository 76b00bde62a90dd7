"""The public calls on a small project."""

from marram import api

FILES = [
    ("src/main.ts", "import { add } from './utils';\nexport function start(x) {\n  return add(x, 1);\n}\n", 1),
    ("src/utils.ts", "export function add(a, b) {\n  return a + b;\n}\nconst MAX_RETRY = 5;\n", 3),
    ("docs/guide.md", "# Guide\n\n## Install\nRun npm install to set up.\nRefund within 24 hours.\n\n## Usage\nUse npm start to begin. See [util](../src/utils.ts).\n", 40),
    ("docs/faq.md", "# FAQ\n\n## Troubleshooting\nIf install fails, clear cache.\nRefund within 48 hours.\n", 100),
    (".env", "TOKEN=1", 1),
]


def test_project(spark):
    corpus = spark.createDataFrame(FILES, "path string, text string, age_days int")
    index = api.build_code_index(corpus)
    assert [(r["src"], r["dst"]) for r in index["edges"].collect()] == [("src/main.ts", "src/utils.ts")]
    assert {(r["src"], r["dst"]) for r in index["calls"].collect()} == {("src/main.ts:start", "src/utils.ts:add")}
    assert {r["path"] for r in api.explore(corpus, paths=["src/*.ts", ".env"])["files"].collect()} == {"src/main.ts", "src/utils.ts"}
    found = api.explore(corpus, "install")
    assert found["docs"].orderBy("rank").first()["path"].startswith("docs/")
    assert api.search(corpus, "utils.ts").first()["path"] == "src/utils.ts"
    assert api.search(corpus, "refund", "content").count() == 2
    (r,) = api.plan_change(spark, index, "src/main.ts", 2, 3).collect()
    assert (r["files"], r["symbols"], r["score"], r["risk"]) == (1, 1, 18.0, "low")
    assert {(r["path"], r["line"]) for r in api.references(index, corpus, "add").collect()} == {("src/main.ts", 1), ("src/main.ts", 3), ("src/utils.ts", 1)}
    assert [(r["a_normal"], r["b_normal"]) for r in api.integrity(corpus)["findings"].collect()] == [("172800s", "86400s")]
    assert [r["resolved"] for r in api.doc_links(corpus).where("category = 'code'").collect()] == ["src/utils.ts"]
    assert api.doc_section(corpus, "Guide > Install").first()["title"] == "Install"
    u = api.understand(spark, corpus, index, "src/utils.ts")
    assert {r["name"] for r in u["symbols"].collect()} == {"add", "MAX_RETRY"} and [r["node"] for r in u["upstream"].collect()] == ["src/main.ts"]
    assert [r["name"] for r in api.suggest_similar(index, "ad").collect()] == ["add"]
    done = api.run_steps([("x", "explore", {"corpus": corpus, "query": None, "paths": ["src/*"]}), ("y", "search", {"corpus": "${x.files}", "query": "main.ts"})])
    assert done["y"].first()["path"] == "src/main.ts"
