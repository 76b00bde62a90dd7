"""Column functions over text: tokens, trigrams, hashes, query analysis, path and line predicates. All are built-ins."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- tokens and trigrams


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order; everything else separates. Null gives null."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def normalized(text: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def trigrams(text: Column) -> Column:
    """All three-character windows of the normalised text, spaces included, with repeats."""
    n = normalized(text)
    # by characters: a substring of a string counts them from its start each time
    grams = F.transform(F.array(F.split(n, "")), lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 2), lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2))))[0]
    return F.when(F.length(n) < 3, F.array().cast("array<string>")).otherwise(grams)


def query_tokens(query: str) -> list[str]:
    """Driver-side: quoted phrases whole, else runs of other than blanks."""
    return [a or b for a, b in re.findall(r'"([^"]*)"|(\S+)', query) if a or b]


def normalized_query(query: Column) -> Column:
    """Signs to spaces, camel case split, single spaces, lower case."""
    q = F.regexp_replace(query, "[^A-Za-z0-9 ]", " ")
    q = F.regexp_replace(q, "([a-z])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(q, " +", " ")))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\r?\n"))


def line_at(text: Column, position: Column) -> Column:
    """The line, from 1, that holds the character at a position from 0."""
    head = F.substr(text, F.lit(1), position)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def truncated(text: Column, most: int) -> Column:
    """At most `most` characters, the last an ellipsis if some are cut; most is held between 16 and 2000."""
    n = min(max(most, 16), 2000)
    return F.when(F.length(text) > n, F.concat(F.substr(text, F.lit(1), F.lit(n - 1)), F.lit("…"))).otherwise(text)


# ---------------------------------------------------------------- hashes and vectors


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a of an ASCII token, as a long."""
    return F.aggregate(F.split(token, ""), F.lit(2166136261).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


# ---------------------------------------------------------------- query analysis

#: Where a run of ASCII letters, digits and _ begins or ends. Java's \b counts other letters too before version 19.
WORD_BOUNDARY = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_words(pattern: str) -> str:
    """The pattern with each \\b as a boundary of ASCII words."""
    return pattern.replace(r"\b", WORD_BOUNDARY)


# Substrings that tell a query's intent, in order of priority.
INTENT_WORDS = {
    "symbol": ["class", "interface", "function", "const", "enum", "type"],
    "file": ["file", "config", "json", "yaml", "xml", "md"],
    "bug": ["error", "bug", "check", "fix", "issue", "fail"],
}

# Words that route a request, in order of priority.
ROUTES = [
    ("change", "modify|change|add|remove|refactor|fix|bug|patch|update|implement|write|edit"),
    ("explore", "find|search|where|location|definition|usage|call|trace|look for|locate"),
    ("write", "create|make|scaffold|generate|template|new file"),
    ("explore", "read|view|preview|content|code|diff|compare|open|show"),
    ("manage", "status|undo|redo|rebuild|index|history|manage|rollback"),
    ("understand", "understand|comprehend|analyze|explain|structure|architecture|logic|summary|report|diagram"),
]


# The same in Korean, in the same order; these stand without word boundaries.
ROUTES_KOREAN = [
    ("change", "수정|변경|추가|삭제|리팩토링|버그|패치"),
    ("explore", "찾|검색|어디|정의|사용|호출|추적|탐색"),
    ("write", "생성|만들|작성|스캐폴드|템플릿"),
    ("explore", "읽|보기|미리보기|내용|코드|비교"),
    ("manage", "상태|되돌리|재실행|인덱스|관리"),
    ("understand", "이해|분석|설명|구조|아키텍처|요약"),
]


@dataclass(frozen=True)
class SeedQuery:
    """A symbol query: terms, the kinds and the file that it is limited to, its scope, and whether usages are asked for."""

    terms: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    file: str | None = None
    scope: str | None = None
    usages: bool = False

    def matches(self, name: Column, kind: Column, path: Column) -> Column:
        """Symbols of the kinds, in the file (any part of its path), whose names hold a term (all, without terms)."""
        out = F.lit(True)
        if self.kinds:
            out = out & kind.isin(list(self.kinds))
        if self.file:
            out = out & F.contains(path, F.lit(self.file))
        hits = [F.contains(F.lower(name), F.lit(t.lower())) for t in self.terms]
        return out & reduce(or_, hits) if hits else out


#: Kinds that a prefix of a symbol query stands for.
SEED_KINDS = {"function": ("function", "method"), "class": ("class",)}


def seed_query(query: str) -> SeedQuery:
    """Reads function:, class:, in:, scope: and usages: from a query; what follows the first two and the last is a term."""
    terms, kinds, found = [], [], {}
    for word in query.split():
        key, colon, rest = word.partition(":")
        if colon and key in SEED_KINDS:
            kinds += SEED_KINDS[key]
        elif colon and key == "usages":
            found["usages"] = True
        elif colon and key in ("in", "scope"):
            if key == "in":
                found["file"] = rest
            elif rest in ("local", "project"):
                found["scope"] = rest
            continue
        else:
            rest = word
        if rest:
            terms.append(rest)
    return SeedQuery(tuple(terms), tuple(kinds), **found)


def _first(pairs: list[tuple[Column, str]], otherwise: str) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def query_intent(query: Column) -> Column:
    q = F.lower(query)
    return _first([(q.rlike("|".join(words)), intent) for intent, words in INTENT_WORDS.items()], "code")


def intent_route(text: Column) -> Column:
    t = F.coalesce(F.lower(text), F.lit(""))
    return _first([(t.rlike(rf"(?<![0-9A-Za-z_])({words})(?![0-9A-Za-z_])|{korean}"), route) for (route, words), (_, korean) in zip(ROUTES, ROUTES_KOREAN, strict=True)], "understand")


def has_path(query: Column) -> Column:
    return query.rlike(r"[\\/]") | query.rlike(r"\.[A-Za-z0-9]+$")


def has_symbol_hint(query: Column) -> Column:
    return query.rlike(ascii_words(r"\b[A-Za-z_$][A-Za-z0-9_$]*\b")) & query.rlike("[A-Z_]")


def strong_query(query: Column) -> Column:
    words = F.size(F.filter(F.split(query, "[ \\t\\r\\n]+"), lambda x: x != ""))
    return has_path(query) | (words >= 2) | (F.length(query) >= 10) | has_symbol_hint(query)


def search_type(query: Column) -> Column:
    return F.when(query.endswith("/"), "directory").when(F.contains(query, F.lit("/")) | query.rlike(r"\.[A-Za-z0-9]+$"), "filename").otherwise("content")


# ---------------------------------------------------------------- paths


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """With its dot, lower-cased; none where the name has no dot past its first character."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def glob_regex(glob: str, *, zero_dirs: bool = False) -> str:
    """A name without slash and wildcard matches a path segment; ** any run, * within a segment, ? one character."""
    if not re.search(r"[/*?]", glob):
        return f"(^|/){re.escape(glob)}(/|$)"
    tail = glob.endswith("/**")
    body = glob[:-3] if tail else glob
    out, i = "", 0
    while i < len(body):
        if zero_dirs and body.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out += {"*": "[^/]*", "?": "."}.get(c, re.escape(c))
            i += 1
    return f"^{out}(/.*)?$" if tail else f"^{out}$"


def path_filter(path: Column, include: list[str], exclude: list[str], *, zero_dirs: bool = False) -> Column:
    """Some include must match if there are any; an exclude drops a path that no include matches."""
    hit = lambda globs: F.lit(False) if not globs else path.rlike("|".join(f"(?:{glob_regex(g, zero_dirs=zero_dirs)})" for g in globs))
    inside = hit(include)
    return (F.lit(not include) | inside) & (inside | ~hit(exclude))


# Names, directories and extensions of sensitive files, and extensions of binary ones.
SENSITIVE_NAMES = [".env", "id_rsa", "id_ed25519", "known_hosts", "authorized_keys"]
SENSITIVE_EXTENSIONS = [".pem", ".p12", ".pfx", ".key", ".kdbx"]
SENSITIVE_DIRS = [".ssh", ".gnupg"]
BINARY_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".ico", ".zip", ".tar", ".gz", ".7z", ".exe", ".dll", ".so", ".dylib", ".class", ".jar"]


def is_sensitive(path: Column) -> Column:
    base = basename(path)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SENSITIVE_DIRS))) | base.isin(SENSITIVE_NAMES) | base.startswith(".env") | extension(path).isin(SENSITIVE_EXTENSIONS)


def is_binary(path: Column) -> Column:
    return extension(path).isin(BINARY_EXTENSIONS)


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|mdx)$")


def is_readme(path: Column) -> Column:
    return F.lower(basename(path)).rlike(r"^readme(\.|$)")


def is_log(path: Column) -> Column:
    return F.lower(path).rlike(r"\.log$|/logs?/")


def is_metrics(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(csv|json|ndjson)$") | F.lower(basename(path)).rlike("metrics?")


def in_scope(path: Column, scope: str, *, logs: bool = False, metrics: bool = False) -> Column:
    """Whether a document is in the scope docs, project or all, with logs and metrics on demand."""
    if scope == "all":
        return F.lit(True)
    inside = is_markdown(path)
    if scope == "docs":
        inside = inside & (path.startswith("docs/") | F.contains(path, F.lit("/docs/")))
    out = is_readme(path) | inside
    if logs:
        out = out | is_log(path)
    return out | is_metrics(path) if metrics else out


def source_type(path: Column) -> Column:
    low = F.lower(path)
    metrics = (low.rlike(r"\.(csv|json)$") & low.rlike("(^|/)(metrics?|monitoring)/")) | F.lower(basename(path)).rlike("metrics?")
    return F.when(is_log(path), "logs").when(metrics, "metrics").when(path.startswith("docs/adr/") | F.contains(path, F.lit("/docs/adr/")), "adr").when(is_readme(path), "readme").otherwise("docs")


def link_category(path: Column) -> Column:
    low = F.lower(path)
    return F.when(path.isNull(), "external").when(is_markdown(path), "docs").when(low.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|kt|swift|cpp|cc|c|h|hpp|json|yml|yaml)$"), "code").otherwise("assets")


def config_type(path: Column) -> Column:
    b = F.lower(basename(path))
    return (
        F.when(b.isin("tsconfig.json", "jsconfig.json"), "tsconfig")
        .when(b == "package.json", "package.json")
        .when(F.contains(b, F.lit(".eslintrc")) | (b == "eslint.config.js"), "lintrc")
        .when(b == ".editorconfig", "editorconfig")
        .when(b.rlike(r"\.(json|yaml|yml|toml)$") | b.startswith("."), "other")
    )


# ---------------------------------------------------------------- HTML

# The entities that are decoded.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """The five entities, each decoded once (an ampersand last)."""
    for k, v in ENTITIES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def html_line(line: Column) -> Column:
    for pattern in ("<!--.*?-->", "(?i)<script.*?</script>", "(?i)<style.*?</style>", "<[^>]+>"):
        line = F.regexp_replace(line, pattern, " ")
    return F.trim(F.regexp_replace(decoded(line), "[ \\t\\r\\n\\f\\x0B]+", " "))


def html_text(html: Column) -> Column:
    """Text line by line, so that line numbers hold; what spans lines stays."""
    return F.array_join(F.transform(F.split(html, "\r?\n"), html_line), "\n")
