"""Column functions on names and source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words of a type's text that name no type
KEYWORDS = ("extends", "super", "var", "final", "void", "boolean", "byte", "char", "short", "int", "long", "float", "double")
# fixed values: words that no question is about
STOP_WORDS = (
    "the", "and", "for", "with", "what", "which", "does", "this", "that", "how", "are", "from",
    "who", "where", "when", "why", "will", "into", "about", "work", "works", "code", "explain",
)
# fixed values: what a name, a dotted name and an annotation look like
WORD = "[A-Za-z_][A-Za-z0-9_]*"
NAME = r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*"
ANNOTATION = r"@[\w.]+(\([^)]*\))?\s*"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def type_tokens(text: Column | str) -> Column:
    """Names in a type's text, in order, each once; annotations, keywords and primitives left out."""
    found = F.regexp_extract_all(F.regexp_replace(col(text), ANNOTATION, ""), F.lit(NAME), F.lit(0))
    return F.array_distinct(F.array_except(found, F.array(*(F.lit(k) for k in KEYWORDS))))


def erased(text: Column | str) -> Column:
    """Simple name of a type: no annotations, type arguments (however deep), white space or package; varargs become an array."""
    out = F.regexp_replace(F.regexp_replace(col(text), ANNOTATION, ""), r"\s+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^<>]*>", ""), r"<[^<>]*>", "")

    def step(state: Column, c: Column) -> Column:
        depth = state["depth"] + F.when(c == "<", 1).when((c == ">") & (state["depth"] > 0), -1).otherwise(0)
        kept = F.when((depth == 0) & (state["depth"] == 0), F.concat(state["out"], c)).otherwise(state["out"])
        return F.struct(depth.alias("depth"), kept.alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    out = F.when(F.contains(out, F.lit("<")), F.aggregate(F.split(out, ""), start, step, lambda s: s["out"])).otherwise(out)
    out = F.regexp_replace(out, r"\.\.\.", "[]")
    return F.coalesce(F.regexp_replace(out, r"^[^\[]*\.", ""), F.lit(""))


def label(qualified_name: Column | str, kind: Column | str, name: Column | str) -> Column:
    """Type#member, constructors as Type(...), endpoints by name; types from the first segment with a capital, or the last one."""
    q, kind, name = col(qualified_name), col(kind), col(name)
    parts = F.split(F.substring_index(q, "#", 1), r"\.", -1)
    capital = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.element_at(parts, i).rlike(r"^\p{Lu}"))
    first = F.when(F.size(capital) > 0, F.try_element_at(capital, F.lit(1))).otherwise(F.size(parts))
    type_ = F.array_join(F.slice(parts, first, F.size(parts)), ".")
    member = F.regexp_extract(q, r"#(.*)$", 1)
    whole = F.when(~F.contains(q, F.lit("#")), type_).when(F.startswith(member, F.lit("<init>")), F.concat(type_, F.substring(member, 7, 1 << 20))).otherwise(F.concat(type_, F.lit("#"), member))
    return F.when(kind == "ENDPOINT", name).otherwise(whole)


def signature(kind: Column | str, visibility: Column | str, modifiers: Column | str, type_text: Column | str, name: Column | str, params: Column | str) -> Column:
    """What a declaration reads like: visibility (package is silent), modifiers (comma apart), type, name and, for methods
    and constructors, parameters; types begin with their kind."""
    kind, visibility, modifiers = col(kind), col(visibility), col(modifiers)
    call = kind.isin("METHOD", "CONSTRUCTOR")
    words = F.concat_ws(
        " ", F.when(visibility != "package", visibility), F.when(F.length(modifiers) > 0, F.regexp_replace(modifiers, ",", " ")),
        F.when(kind == "CONSTRUCTOR", None).when(call | (kind == "FIELD"), col(type_text)).otherwise(F.lower(kind)), col(name),
    )
    return F.when(call, F.concat(words, F.lit("("), F.coalesce(col(params), F.lit("")), F.lit(")"))).otherwise(words)


def is_source(path: Column | str) -> Column:
    p = col(path)
    return p.endswith(".java") & ~p.endswith("package-info.java") & ~p.endswith("module-info.java")


def is_test(path: Column | str) -> Column:
    p = col(path)
    return p.contains("src/test/") | p.contains("/src/integrationTest/") | p.rlike(r"(Test|Tests|IT|TestCase)\.java$")


def lines_of_code(text: Column | str) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(col(text), "\n", -1), lambda x: F.length(F.regexp_replace(x, r"[\s]+", "")) > 0)).cast("long")


def excerpt(text: Column | str, first: Column | int, last: Column | int, most: int = 2000) -> Column:
    """Lines first to last, at most so many."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    start = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(F.split(col(text), "\n", -1), start, F.greatest(F.lit(0), F.least(last - start + 1, F.lit(most)))), "\n")


def decoded(content: Column | str) -> Column:
    """Bytes as text: UTF-8, or else ISO 8859-1."""
    c = col(content)
    return F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1"))


def terms(text: Column | str) -> Column:
    """Words and parts of camel case of three characters or more, in lower case, each once, sorted; stop words left out."""
    words = F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0))
    parts = F.flatten(F.transform(words, lambda w: F.split(F.regexp_replace(w, "([a-z0-9])([A-Z])", "$1 $2"), " ")))
    every = F.transform(F.filter(F.concat(words, parts), lambda w: F.length(w) >= 3), lambda w: F.lower(w))
    return F.array_sort(F.array_except(every, F.array(*(F.lit(w) for w in STOP_WORDS))))


def mentioned(text: Column | str) -> Column:
    """Words with a capital anywhere, in lower case, each once, sorted."""
    named = F.filter(F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0)), lambda w: w.rlike("[A-Z]"))
    return F.array_sort(F.array_distinct(F.transform(named, lambda w: F.lower(w))))


def repository_name(url: Column | str) -> Column:
    """Last part of a URL without .git."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(url), r"[/?#]+$", ""), r"^.*[/:]", ""), r"\.git$", "")


def package_of(qualified_name: Column | str) -> Column:
    """What stands before a type's last segment."""
    return F.regexp_extract(F.substring_index(col(qualified_name), "#", 1), r"^(.*)\.[^.]*$", 1)


def chunk_hash(label_: Column | str, text: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(col(label_), F.lit("\n"), col(text)), 256), 1, 16)


def duration(ms: Column | str) -> Column:
    """Milliseconds as text: 850 ms, 12.3 s, 4 min."""
    ms = col(ms)
    seconds = F.concat(F.format_number(ms / 1000, 1), F.lit(" s"))
    return F.when(ms.isNull(), "-").when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(ms < 60_000, seconds).otherwise(F.concat(F.floor(ms / 60_000 + 0.5).cast("string"), F.lit(" min")))


def percent(part: Column | str, total: Column | str) -> Column:
    part, total = col(part), col(total)
    return F.when(total == 0, "-").otherwise(F.concat(F.floor(part / total * 100 + 0.5).cast("string"), F.lit("%")))
