"""Documents as rows: lines, headings, outlines, links, references, chunks, previews, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions import text as T


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, text): every line, from 1."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\r?\n")).alias("p", "text")).select(id_col, (F.col("p") + 1).cast("long").alias("line"), "text")


def outside_fences(numbered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines outside code fences, the fence lines left out."""
    fence = F.trim("text").startswith("```")
    before = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("__f", fence).withColumn("__n", F.sum(F.col("__f").cast("int")).over(before)).where(~F.col("__f") & (F.col("__n") % 2 == 0)).drop("__f", "__n")


def markdown_headings(numbered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line, level, title) of # headings outside fences; closing # and inline tags are cut."""
    hit = outside_fences(numbered, id_col).where(F.col("text").rlike("^#{1,6}[ \\t]+"))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "^#{1,6}[ \\t]+", ""), "[ \\t]*#+[ \\t]*$", ""), "<[^>]+>", ""))
    return hit.select(id_col, "line", F.length(F.regexp_extract("text", "^(#+)", 1)).cast("int").alias("level"), title.alias("title"))


def text_headings(numbered: DataFrame, id_col: str = "doc_id", *, least: int = 3, most: int = 80, depth: int = 3) -> DataFrame:
    """(id, line, level, title): # headings, underlined, numbered and all-capital lines of plain text.

    A line that underlines an accepted heading is no heading itself: lead sees the underline, lag what was above.
    """
    w = Window.partitionBy(id_col).orderBy("line")
    d = numbered.select(id_col, "line", F.trim("text").alias("t")).withColumn("next", F.lead("t").over(w)).withColumn("above", F.lag("t").over(w))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "[*_`~]+", ""))
    fits = lambda c: F.length(clean(c)).between(least, most)
    md = F.col("t").rlike("^#{1,6}[ \\t]+.+$")
    md_level, md_title = F.length(F.regexp_extract("t", "^(#+)", 1)), F.regexp_extract("t", "^#{1,6}[ \\t]+(.+)$", 1)
    underline = F.coalesce(F.col("next").rlike("^(=+|-+)$"), F.lit(False)) & fits(F.col("t"))
    number = F.col("t").rlike(r"^[0-9]{1,3}[.)][ \t]+.+$")
    number_title = F.regexp_extract("t", r"^[0-9]{1,3}[.)][ \t]+(.+)$", 1)
    capitals = F.col("t").rlike("^[A-Z0-9 _-]+$") & (F.length(F.regexp_replace("t", "[^A-Z]", "")) >= 3) & (F.length(F.regexp_replace("t", "[^ ]", "")) <= F.greatest(F.lit(10), F.floor(F.length("t") * 0.4)))
    found = (
        F.when(F.col("t") == "", None)
        .when(md, F.when(fits(md_title) & (md_level <= depth), F.struct(md_level.alias("level"), clean(md_title).alias("title"))))
        .when(underline, F.struct(F.when(F.col("next").startswith("="), 1).otherwise(2).alias("level"), clean(F.col("t")).alias("title")))
        .when(number & fits(number_title), F.struct(F.lit(2).alias("level"), clean(number_title).alias("title")))
        .when(capitals & fits(F.col("t")), F.struct(F.lit(2).alias("level"), clean(F.col("t")).alias("title")))
    )
    consumed = F.col("t").rlike("^(=+|-+)$") & F.coalesce(F.length(clean(F.col("above"))).between(least, most) & ~F.col("above").rlike("^#{1,6}[ \\t]+.+$"), F.lit(False))
    return d.withColumn("h", found).where(F.col("h").isNotNull() & ~consumed).select(id_col, "line", F.col("h.level").cast("int").alias("level"), F.col("h.title").alias("title"))


def outline(headings: DataFrame, totals: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line, end_line, level, title, path, ordinal, section_id): a section ends before the next heading; path is the titles
    of the enclosing headings; sections that share a path are numbered; the id is a hash of all that. totals: (id, n_lines).

    The enclosing heading at each level is the last one above of that level with no heading of a lower level since, found by
    running maxima, one for each of six levels.
    """
    w = Window.partitionBy(id_col).orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = headings.join(totals, id_col).withColumn("end_line", F.coalesce(F.lead("line").over(w) - 1, F.col("n_lines")))
    for k in range(1, 7):
        d = d.withColumn(f"__l{k}", F.max(F.when(F.col("level") == k, F.struct("line", "title"))).over(upto))
        d = d.withColumn(f"__c{k}", F.coalesce(F.max(F.when(F.col("level") < k, F.col("line"))).over(upto), F.lit(0)))
    parts = [F.when((F.lit(k) < F.col("level")) & (F.col(f"__l{k}.line") > F.col(f"__c{k}")), F.col(f"__l{k}.title")) for k in range(1, 7)]
    d = d.withColumn("path", F.array_join(F.array_append(F.array_compact(F.array(*parts)), F.col("title")), " > "))
    d = d.withColumn("ordinal", F.row_number().over(Window.partitionBy(id_col, "path").orderBy("line")).cast("long"))
    d = d.withColumn("section_id", F.sha2(F.concat_ws("\n", F.col(id_col).cast("string"), "path", F.col("ordinal").cast("string")), 256))
    return d.select(id_col, "line", "end_line", "level", "title", "path", "ordinal", "section_id")


def skeleton(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, skeleton): the headings as an indented list."""
    row = F.struct("line", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), "title").alias("s"))
    return sections.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["s"]), "\n").alias("skeleton"))


def line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, chunk_id, content_hash): one chunk for each line that is not blank, as of a log."""
    d = lines(docs, id_col, text_col).where(F.trim("text") != "")
    return d.select(id_col, "line", F.sha2(F.concat_ws("\n", F.col(id_col).cast("string"), F.col("line").cast("string")), 256).alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))


def packed_chunks(docs: DataFrame, target: int = 1200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, start_line, end_line, n_chars): lines packed greedily up to `target` characters; a longer line stands alone.

    A fold over the lines' lengths keeps (chunk, filled) for each line; texts are not shuffled.
    """
    sizes = F.transform(F.split(text_col, "\r?\n"), lambda x: F.length(x).cast("long") + 1)
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("f"), F.array().cast("array<long>").alias("of"))

    def step(a, n):
        fits = (a["f"] == 0) | (a["f"] + n <= target)
        c = F.when(fits, a["c"]).otherwise(a["c"] + 1)
        return F.struct(c.alias("c"), F.when(fits, a["f"] + n).otherwise(n).alias("f"), F.array_append(a["of"], c).alias("of"))

    d = docs.select(id_col, sizes.alias("n")).select(id_col, "n", F.aggregate("n", start, step)["of"].alias("of"))
    d = d.select(id_col, F.posexplode(F.arrays_zip("n", "of")).alias("p", "x"))
    return d.groupBy(id_col, F.col("x.of").alias("chunk")).agg((F.min("p") + 1).cast("long").alias("start_line"), (F.max("p") + 1).cast("long").alias("end_line"), F.sum("x.n").alias("n_chars"))


def front_matter(text: Column) -> Column:
    """The key: value lines between --- at the head of a text, as a map."""
    block = F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    pairs = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike("^[A-Za-z0-9_-]+:"))
    entry = lambda x: F.struct(F.regexp_extract(x, "^([A-Za-z0-9_-]+):", 1).alias("k"), F.trim(F.regexp_extract(x, "^[A-Za-z0-9_-]+:(.*)$", 1)).alias("v"))
    return F.map_from_entries(F.transform(pairs, entry))


def html_references(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, kind, href): references of a, link, script and img tags, with repeats."""
    out = None
    for tag, attribute in (("a", "href"), ("link", "href"), ("script", "src"), ("img", "src")):
        # a quoted or bare value; the tag's own matches first, then the value of each
        tags = F.regexp_extract_all(html_col, F.lit(T.ascii_words(rf"(?i)(<{tag}\b[^>]*\b{attribute}\s*=\s*(?:\"[^\"]+\"|'[^']+'|[^\s>]+)[^>]*>)")), F.lit(1))
        part = pages.select(id_col, F.lit(tag).alias("kind"), F.explode(tags).alias("t"))
        value = F.regexp_extract("t", T.ascii_words(rf"(?i)^<{tag}\b[^>]*\b{attribute}\s*=\s*(\"[^\"]+\"|'[^']+'|[^\s>]+)"), 1)
        part = part.select(id_col, "kind", F.trim(F.regexp_replace(value, "^[\"']|[\"']$", "")).alias("href")).where("href <> ''")
        out = part if out is None else out.unionByName(part)
    return out


def html_headings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, level, title) of h1 to h6."""
    d = pages.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit(T.ascii_words(r"(?is)(<h([1-6])\b[^>]*>.*?</h\2>)")), F.lit(1))).alias("t"))
    title = F.trim(F.regexp_replace(T.decoded(F.regexp_replace(F.regexp_extract("t", "(?is)^<h[1-6][^>]*>(.*)</h[1-6]>$", 1), "<[^>]+>", " ")), "[ \\t\\r\\n]+", " "))
    return d.select(id_col, F.substring("t", 3, 1).cast("int").alias("level"), title.alias("title")).where("title <> ''")


def markdown_links(numbered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line, label, href): inline links and reference links with a definition; images and fenced lines are left out."""
    d = outside_fences(numbered, id_col)
    inline = d.select(id_col, "line", F.explode(F.regexp_extract_all("text", F.lit(r"((?<!!)\[[^\]]+\]\([^)\s]+[^)]*\))"), F.lit(1))).alias("m"))
    inline = inline.select(id_col, "line", F.regexp_extract("m", r"^\[([^\]]+)\]", 1).alias("label"), F.regexp_extract("m", r"\]\(([^)\s]+)", 1).alias("href"))
    defined = d.where(F.col("text").rlike(r"^\s*\[[^\]]+\]:\s*\S+")).select(id_col, F.lower(F.regexp_extract("text", r"^\s*\[([^\]]+)\]:", 1)).alias("key"), F.regexp_extract("text", r"\]:\s*(\S+)", 1).alias("href"))
    used = d.select(id_col, "line", F.explode(F.regexp_extract_all("text", F.lit(r"((?<!!)\[[^\]]+\]\[[^\]]*\])"), F.lit(1))).alias("m"))
    used = used.select(id_col, "line", F.regexp_extract("m", r"^\[([^\]]+)\]", 1).alias("label"), F.lower(F.regexp_extract("m", r"\]\[([^\]]*)\]$", 1)).alias("key"))
    used = used.withColumn("key", F.when(F.col("key") == "", F.lower("label")).otherwise(F.col("key")))
    return inline.unionByName(used.join(defined, [id_col, "key"]).select(id_col, "line", "label", "href"))


def resolve_link(path: Column, href: Column) -> Column:
    """A file in the corpus that href points to from path: null for other schemes and bare fragments."""
    target = F.regexp_replace(href, "[#?].*$", "")
    start = F.when(target.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1))
    segments = F.concat(start, F.filter(F.split(target, "/"), lambda x: x != ""))

    def walk(acc, x):
        return F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))

    done = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), walk), "/")
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (target == ""), None).otherwise(done)


# Words that are no mentions.
COMMON_WORDS = (
    "the and or for with from that this these those are was were been have has had not can will may might should would into over under "
    "when where what which why how also only more most some any all each per via etc ex vs aka note todo"
).split()


def mentions(numbered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text, kind, line): symbols and paths that lines outside fences name, each with its first line."""
    d = outside_fences(numbered, id_col)
    every = lambda p: F.regexp_extract_all("text", F.lit(T.ascii_words(p)), F.lit(1))
    code = F.flatten(F.transform(every(r"`([^`]+)`"), lambda x: F.split(x, r"\s+")))
    module = F.when(F.col("text").rlike(T.ascii_words(r"^\s*(import|export)\b")), F.concat(every(r"\bfrom\s+['\"]([^'\"]+)['\"]"), every(r"\bimport\s+['\"]([^'\"]+)['\"]"))).otherwise(F.array().cast("array<string>"))
    plain = F.regexp_replace(F.regexp_replace("text", r"`[^`]+`|!\[[^\]]*\]\([^)]+\)|\[[^\]]+\]\([^)]+\)", " "), r"[#>*_-]{2,}", " ")
    worth = lambda x: F.length(x).between(3, 60) & ~x.rlike("^[0-9]+$") & ~F.lower(x).isin(COMMON_WORDS) & x.rlike(r"/|\.[A-Za-z0-9]+$|[A-Z]|_")
    words = F.filter(F.split(plain, r"[^A-Za-z0-9_./$#]+"), worth)
    found = F.concat(code, module, every(r"<([A-Z][A-Za-z0-9_$.]*)\b"), every(r"\{\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*\}"), words)
    m = d.select(id_col, "line", F.explode(found).alias("m"))
    m = m.withColumn("m", F.regexp_replace(F.regexp_replace("m", r"^[`\"'(<\[{]+", ""), r"[`\"'\\\]})>,;:.]+$", ""))
    m = m.withColumn("m", F.regexp_replace(F.regexp_replace("m", "#.*$", ""), r"(\(\)|\[\])$", ""))
    kind = F.when(F.col("m").rlike(r"^\.\.?/|/|\.[A-Za-z0-9]+$"), "path").when(F.col("m").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*$") & (F.length("m") >= 2), "symbol")
    m = m.withColumn("kind", kind).where((F.col("m") != "") & (F.length("m") <= 120) & F.col("kind").isNotNull())
    return m.groupBy(id_col, F.col("m").alias("text"), "kind").agg(F.min("line").alias("line"))


def format_profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, newline, tabs, indent), a row for each row: crlf, lf or mixed (null without a text); whether lines begin with tabs; the
    most frequent indent (least among equals) of lines that hold more than spaces."""
    crlf, lf = F.regexp_count(text_col, F.lit("\r\n")), F.regexp_count(text_col, F.lit("\n"))
    newline = F.when(crlf == 0, "lf").when(crlf == lf, "crlf").when(crlf < lf, "mixed")
    once = lambda x, f: F.transform(F.array(x), f)[0]
    spaces = lambda ls: F.filter(F.transform(ls, lambda x: F.length(x) - F.length(F.ltrim(x))), lambda n: n > 0)
    full = F.filter(F.split(text_col, "\r?\n"), lambda x: F.ltrim(x) != "")

    def usual(ns):
        counted = F.transform(F.array_distinct(ns), lambda n: F.struct(F.size(F.filter(ns, lambda m: m == n)).alias("k"), (-n).alias("n")))
        return -F.array_max(counted)["n"]

    return docs.select(id_col, newline.alias("newline"), F.exists(F.split(text_col, "\r?\n"), lambda x: x.startswith("\t")).alias("tabs"), once(spaces(full), usual).alias("indent"))


def preview_lines(docs: DataFrame, query: str, most_lines: int = 3, most_chars: int = 240, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, preview): lines by score (headings, bullets, notes, query hits; long ones less), skipping repeats and what does not fit,
    put back in order; the head of the text where no line scores."""
    terms = list(dict.fromkeys(x for x in T.query_tokens(query.lower()) if len(x) >= 3))[:12]
    numbered = F.transform(F.split(text_col, "\r?\n"), lambda x, i: F.struct(F.trim(x).alias("t"), i.alias("i")))

    def score(t):
        hits = sum((F.contains(F.lower(t), F.lit(w)).cast("int") for w in terms), F.lit(0))
        long = F.when(F.length(t) > 500, -7).when(F.length(t) > 220, -2).otherwise(0)
        return F.when(t.rlike("^#{1,6} "), 4).otherwise(0) + F.when(t.rlike(r"^([-*+]|[0-9]+[.)]) "), 3).otherwise(0) + F.when(t.rlike("(?i)^(note|warning|caution|important)"), 3).otherwise(0) + F.when(hits > 0, hits + 6).otherwise(0) + long

    scored = F.filter(F.transform(numbered, lambda x: F.struct((-score(x["t"])).alias("s"), x["i"].alias("i"), x["t"].alias("t"))), lambda x: (x["s"] < 0) & (x["t"] != ""))
    empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<i:int,t:string>>").alias("got"))

    def take(a, x):
        fits = (F.size(a["got"]) < most_lines) & (a["n"] + F.length(x["t"]) + 1 <= most_chars) & ~F.exists(a["got"], lambda g: g["t"] == x["t"])
        return F.when(fits, F.struct((a["n"] + F.length(x["t"]) + 1).alias("n"), F.array_append(a["got"], F.struct(x["i"].alias("i"), x["t"].alias("t"))).alias("got"))).otherwise(a)

    got = F.aggregate(F.sort_array(scored), empty, take)["got"]
    text = F.array_join(F.transform(F.sort_array(got), lambda x: x["t"]), "\n")
    return docs.select(id_col, F.when(text == "", F.substring(text_col, 1, most_chars)).otherwise(text).alias("preview"))


def merged_ranges(ranges: DataFrame, by: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """(by, start, end): ranges that overlap or lie at most `gap` apart as one. Rows without a start come last and join the last of
    their group; equal rows are one, whatever their order."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    d = ranges.withColumn("__m", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("__new", F.when(F.col("__m").isNull() | (F.col(start) > F.col("__m") + gap), 1).otherwise(0)).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")


def structural_segments(numbered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, segment, kind, start_line, end_line): runs of lines of a kind: fence (with its marks), table, list, text; blank lines part
    text and end lists and tables. Windows by document only, so a segment never leaves it."""
    w = Window.partitionBy(id_col).orderBy("line")
    mark = F.trim("text").startswith("```")
    d = numbered.withColumn("__m", F.sum(mark.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kind = (
        F.when(mark | (F.col("__m") % 2 == 1), "fence")
        .when(F.trim("text") == "", "blank")
        .when(F.contains("text", F.lit("|")), "table")
        .when(F.col("text").rlike(r"^\s*([-*+]|[0-9]+[.)])\s"), "list")
        .otherwise("text")
    )
    # the two marks of a fence share a number: an opening one begins a segment, what follows the closing one the next
    d = d.withColumn("kind", kind).withColumn("__k", F.concat("kind", F.when(F.col("kind") == "fence", F.floor((F.col("__m") + 1) / 2).cast("string")).otherwise("")))
    d = d.withColumn("__new", F.when(F.lag("__k").over(w).eqNullSafe(F.col("__k")), 0).otherwise(1))
    d = d.withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'blank'")
    return d.groupBy(id_col, "segment", "kind").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"))
