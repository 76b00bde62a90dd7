"""Consistency audits: claims from lines, numeric constraints from claims, conflicts between constraints, a health report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions import text as T

# What makes a line a claim, and of which strength.
MUST = T.ascii_words(r"(?i)\b(must|shall|required|mandatory|not allowed|prohibited)\b|반드시|해야\s*한다|필수|금지|불가")
SHOULD = T.ascii_words(r"(?i)\b(should|recommended|prefer|ideally)\b|권장|가능하면|되도록")
NUMBER = T.ascii_words(r"(?i)\b\d+(?:\.\d+)?\s*(ms|s|sec|seconds|m|min|minutes|h|hr|hours|d|days|percent)\b|\d+(?:\.\d+)?\s*(초|분|시간|일|개월|퍼센트|%)")

# Tags by words of the text and by directories of the path.
TEXT_TAGS = {
    "security": T.ascii_words(r"(?i)\b(auth|oauth|token|secret|encrypt|tls|jwt|password|credential|security)\b"),
    "data-loss": T.ascii_words(r"(?i)\b(delete|drop|purge|truncate|backup|restore|wipe|loss|data\s*loss)\b"),
    "payment": T.ascii_words(r"(?i)\b(payment|billing|invoice|refund|charge|settle|payout)\b"),
}
PATH_TAGS = {"security": "(?i)/(auth|security|crypto|secrets?)/", "data-loss": "(?i)/(backup|restore|migrations?)/", "payment": "(?i)/(billing|payment|checkout|refund)"}

# Units, the words that bound a value, and words that do not name what is bounded.
UNITS = "ms|s|sec|seconds|m|min|minutes|h|hr|hours|d|days|%|percent"
KO_UNITS = "초|분|시간|일|개월|퍼센트"
STOPWORDS = (
    "the a an to for of and is are be with within at most no more than less maximum limit max min under over "
    "time window hour hours minute minutes second seconds day days ms s m h d 은 는 이 가 을 를 의 와 과 및 에서 로 으로 하다 합니다 초 분 시간 일 개월"
).split()
SECONDS = {"s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "mo": 2592000.0}


def strength(line: Column) -> Column:
    return F.when(line.rlike(MUST), "must").when(line.rlike(SHOULD), "should").when(line.rlike(NUMBER), "must")


def tags(text: Column, path: Column) -> Column:
    t = F.regexp_replace(text, "[_-]+", " ")
    return F.array_compact(F.array(*(F.when(t.rlike(TEXT_TAGS[k]) | path.rlike(PATH_TAGS[k]), F.lit(k)) for k in TEXT_TAGS)))


def text_claims(numbered: DataFrame) -> DataFrame:
    """(id, path, line, text, strength, tags) of (path, line, text): lines of 8 or more characters outside fences that bind;
    a line that a path repeats counts once."""
    from marram.operators.documents import outside_fences

    d = outside_fences(numbered, "path").withColumn("text", F.trim("text")).where(F.length("text") >= 8).withColumn("strength", strength(F.col("text"))).where("strength is not null")
    d = d.groupBy("path", "text", "strength").agg(F.min("line").alias("line"))
    return d.select(F.sha2(F.concat(F.col("path"), F.lit("::::"), F.col("text")), 256).alias("id"), "path", "line", "text", "strength", tags(F.col("text"), F.col("path")).alias("tags"))


def unit_of_name(name: Column) -> Column:
    u = F.upper(name)
    has = lambda x: F.contains(u, F.lit(x))
    return F.when(has("MS"), "ms").when(has("SEC"), "s").when(has("MIN"), "m").when(has("HOUR"), "h").when(has("DAY"), "d").otherwise("")


def code_claims(numbered: DataFrame) -> DataFrame:
    """(path, line, text) of (path, line, text): constants with a number, and comparisons in an if."""
    d = numbered.withColumn("t", F.trim("text")).where((F.col("t") != "") & ~F.col("t").startswith("//"))
    const = r"(?:const|let|var)\s+([A-Z0-9_]{3,})\s*=\s*(\d+(?:\.\d+)?)"
    cond = r"(?i)if\s*\(([^)]*?)(<=|>=|<|>)\s*(\d+(?:\.\d+)?)(?:\s*(ms|s|sec|seconds|m|min|minutes|h|hr|hours|d|days))?\)"
    tail = lambda u: F.when(u != "", F.concat(F.lit(" "), u)).otherwise("")
    name = F.regexp_extract("t", const, 1)
    a = F.when(name != "", F.concat(name, F.lit(" = "), F.regexp_extract("t", const, 2), tail(unit_of_name(name))))
    subject = F.trim(F.regexp_extract("t", cond, 1))
    unit = F.when(F.regexp_extract("t", cond, 4) != "", F.regexp_extract("t", cond, 4)).otherwise(unit_of_name(subject))
    b = F.when(F.col("t").rlike(cond), F.concat(F.when(subject == "", "constraint").otherwise(subject), F.lit(" "), F.regexp_extract("t", cond, 2), F.lit(" "), F.regexp_extract("t", cond, 3), tail(unit)))
    return d.select("path", "line", F.explode(F.array_compact(F.array(a, b))).alias("text"))


def constraint(text: Column) -> Column:
    """A struct (label, value, unit) of the first form that a claim has: within / at most n unit, its Korean kin, comparison, assignment."""
    both = f"{UNITS}|{KO_UNITS}"
    forms = [
        (T.ascii_words(rf"(?i)(.+?)\b(within|at most|no more than|less than|<=)\s*(\d+(?:\.\d+)?)\s*({UNITS})?"), 3, 4),
        (rf"(?i)(.+?)(이내|이하|최대)\s*(\d+(?:\.\d+)?)\s*({KO_UNITS}|%)?", 3, 4),
        (rf"(?i)(.+?)\s*(<=|>=|<|>)\s*(\d+(?:\.\d+)?)\s*({both})?", 3, 4),
        (rf"(?i)(.+?)\s*=\s*(\d+(?:\.\d+)?)\s*({both})?", 2, 3),
    ]
    part = lambda p, i: F.regexp_extract(text, p, i)
    return F.coalesce(*(F.when(text.rlike(p), F.struct(part(p, 1).alias("label"), part(p, v).cast("double").alias("value"), F.lower(part(p, u)).alias("unit"))) for p, v, u in forms))


def label_unit(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.rlike("ms|millisecond"), "ms").when(low.rlike("sec|초"), "s").when(low.rlike("min|분"), "m").when(low.rlike("hour|시간"), "h").when(low.rlike("day|일"), "d").otherwise("")


def normal_unit(unit: Column) -> Column:
    return (
        F.when(unit.isin("%", "percent", "퍼센트"), "%").when(unit == "ms", "ms").when(unit.isin("s", "sec", "seconds", "초"), "s").when(unit.isin("m", "min", "minutes", "분"), "m")
        .when(unit.isin("h", "hr", "hours", "시간"), "h").when(unit.isin("d", "days", "일"), "d").when(unit == "개월", "mo").otherwise(unit)
    )


def normal_key(label: Column) -> Column:
    """The last three words of a label that name something."""
    w = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9가-힣\s]", " "), r"\s+", " ")), " ")
    kept = F.filter(w, lambda x: (x != "") & ~x.isin(STOPWORDS))
    return F.array_join(F.slice(kept, F.greatest(F.size(kept) - 2, F.lit(1)), F.lit(3)), " ")


def constraints(claims: DataFrame) -> DataFrame:
    """claims with key, unit_type and normal (value in whole seconds, or value and unit), of those that bound something."""
    d = claims.withColumn("c", constraint(F.col("text"))).where("c is not null")
    d = d.withColumn("unit", normal_unit(F.when(F.col("c.unit") != "", F.col("c.unit")).otherwise(label_unit(F.col("c.label"))))).withColumn("key", normal_key(F.col("c.label"))).where("key <> ''")
    timed = F.col("unit").isin("ms", *SECONDS)
    scale = F.when(F.col("unit") == "ms", 0.001)
    for u, x in SECONDS.items():
        scale = scale.when(F.col("unit") == u, x)
    value = F.col("c.value")
    seconds = F.floor(F.when(F.col("unit") == "ms", value / 1000).otherwise(value * scale) + 0.5)
    plain = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    normal = F.when(timed, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(plain, "unit"))
    return d.select(*claims.columns, "key", F.when(timed, "time").when(F.col("unit") == "%", "percent").otherwise("unitless").alias("unit_type"), normal.alias("normal"))


def conflicts(bounded: DataFrame) -> DataFrame:
    """(key, unit_type, a_path, a_text, a_normal, b_..., tags, severity, confidence, priority): of each key and unit type, the first
    claims (by path, line) of the first two values, where their paths differ. Aggregates only: firsts of values, then two of these."""
    first = F.struct("path", "line", "normal", "text", "strength", "tags")
    by = bounded.groupBy("key", "unit_type", "normal").agg(F.min(first).alias("f"))
    pair = by.groupBy("key", "unit_type").agg(F.slice(F.sort_array(F.collect_list("f")), 1, 2).alias("p")).where(F.size("p") == 2)
    d = pair.select("key", "unit_type", F.col("p")[0].alias("a"), F.col("p")[1].alias("b")).where("a.path <> b.path")
    all_tags = F.array_distinct(F.concat("a.tags", "b.tags"))
    must, should = ((F.col("a.strength") == s) | (F.col("b.strength") == s) for s in ("must", "should"))
    severity = F.when(F.size(all_tags) > 0, "high").when(must | should, "warn").otherwise("info")
    confidence = F.least(F.lit(0.9), F.lit(0.55) + F.when(must, 0.15).otherwise(0.0) + F.when(should, 0.05).otherwise(0.0))
    base = F.when(severity == "high", 1.0).when(severity == "warn", 0.6).otherwise(0.3)
    return d.select(
        "key", "unit_type", *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("path", "text", "normal")),
        all_tags.alias("tags"), severity.alias("severity"), confidence.alias("confidence"), (base * confidence + F.when(F.size(all_tags) > 0, 0.1).otherwise(0.0)).alias("priority"),
    )


def finding_kind(a: Column, b: Column) -> Column:
    code = (a == "code") | (b == "code")
    either = lambda *xs: a.isin(*xs) | b.isin(*xs)
    return F.when(code & either("comment"), "comment_vs_code").when(code & either("adr"), "adr_vs_code").when(code & either("docs", "readme", "logs", "metrics"), "doc_vs_code").otherwise("doc_vs_doc")


def report(findings: DataFrame) -> DataFrame:
    """One row: findings, by severity, and health: 1 less the weighted confidences (0.1, 0.3, 0.6) over five."""
    weight = F.when(F.col("severity") == "high", 0.6).when(F.col("severity") == "warn", 0.3).otherwise(0.1)
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warn", "high")]
    return findings.agg(F.count(F.lit(1)).alias("findings"), *counts, (1 - F.least(F.lit(1.0), F.coalesce(F.sum(weight * F.col("confidence")), F.lit(0.0)) / 5)).alias("health"))


def top_domains(findings: DataFrame, k: int = 3) -> DataFrame:
    return findings.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def blocked(findings: DataFrame, strict: bool = False) -> DataFrame:
    levels = ["high", "warn"] if strict else ["high"]
    return findings.agg((F.count_if(F.col("severity").isin(levels)) > 0).alias("blocked"))


def expand_scope(claims: int, findings: int, confidence: float | None, spec_like: bool, *, least_claims: int = 4, least_findings: int = 2, least_confidence: float = 0.65) -> str | None:
    """Why an audit of the docs goes on to the whole project, or None."""
    if claims < least_claims:
        return "insufficient_claims"
    if 0 < findings < least_findings:
        return "few_findings"
    if confidence is not None and confidence < least_confidence:
        return "low_confidence"
    return "spec_query" if spec_like else None
