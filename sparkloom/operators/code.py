"""Code blocks as Column expressions: extraction, language, validity, complexity, summaries (CD1-CD20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.text import white_words
from sparkloom.operators.quality import any_of, total

L = F.lit
#: Languages that are told apart (fixed values).
LANGUAGES = ["python", "javascript", "typescript", "java", "cpp", "c", "csharp", "php", "ruby", "go", "rust", "sql", "html", "css", "shell", "yaml", "json", "xml", "unknown"]
#: Other names of languages (fixed values).
ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "c++": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp", "sh": "shell", "bash": "shell", "zsh": "shell", "fish": "shell", "yml": "yaml", "htm": "html"}
#: Patterns that tell a language, in the order in which they are tried (fixed values). ``|``: the literals that do as well.
RULES: list[tuple[str, list[str], list[str]]] = [
    ("typescript", [r"\binterface\s+\w+", r"\btype\s+\w+\s*=", r":\s*(string|number|boolean|any)"], []),
    ("python", [r"\bdef\s+\w+\s*\(", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import"], ["print("]),
    ("javascript", [r"\bfunction\s+\w+\s*\(", r"\bconst\s+\w+\s*=", r"\blet\s+\w+\s*="], ["console.log("]),
    ("java", [r"\bpublic\s+class\s+\w+", r"\bpublic\s+static\s+void\s+main"], ["System.out.println("]),
    ("c", [r"#include\s*<", r"\bint\s+main\s*\("], []),
    ("sql", [r"(?i)\bSELECT\s+", r"(?i)\bINSERT\s+INTO", r"(?i)\bCREATE\s+TABLE", r"(?i)\bUPDATE\s+", r"(?i)\bDELETE\s+FROM", r"(?i)\bFROM\s+\w+"], []),
]
DECISIONS = [r"\bif\b", r"\belse\b", r"\belif\b", r"\bwhile\b", r"\bfor\b", r"\btry\b", r"\bcatch\b", r"\bexcept\b", r"\bfinally\b", r"\bswitch\b", r"\bcase\b", r"\band\b", r"\bor\b", r"&&", r"\|\|"]
CONTROL = [r"(?i)\b(if|else|elif|switch|case)\b", r"(?i)\b(for|while|do|foreach)\b", r"(?i)\b(try|catch|except|finally)\b"]
ADVANCED = [r"(?i)\b(async|await|promise)\b", r"(?i)\b(lambda|=>\s*\{|\s*->\s*)", r"(?i)\b(yield|generator)\b", r"@\w+", r"(?i)\b(interface|abstract|extends|implements)\b"]
#: Patterns of demanding code by language (fixed values).
DEMANDING = {
    "python": [r"\bclass\s", r"\btry:", r"\basync\s+def\b", r"@[a-zA-Z0-9_.]+", r"\byield\s", r"with\s+"],
    "javascript": [r"\bclass\s", r"\btry\s*\{", r"\basync\s+function\b", r"\bawait\s", r"Promise\."],
    "typescript": [r"\bclass\s", r"\binterface\s", r"\btry\s*\{", r"\basync\s+function\b", r"\bawait\s", r"<[A-Z][a-zA-Z0-9_]*>"],
    "java": [r"\bclass\s", r"\binterface\s", r"\btry\s*\{", r"\bfinally\s*\{", r"\bsynchronized\b", r"<[A-Z][a-zA-Z0-9_]*>"],
    "sql": [r"(?i)\bJOIN\b", r"(?i)\bUNION\b", r"(?i)\bWITH\b", r"(?i)\bGROUP\s+BY\b", r"(?i)\(SELECT"],
    "rust": [r"\bunsafe\b", r"\basync\b", r"\bawait\b", r"\btrait\b", r"<'"],
}
DATA, MARKUP = ["json", "yaml", "xml"], ["html", "css"]
PROGRAMS = ["python", "javascript", "typescript", "java", "cpp", "c", "csharp", "php", "ruby", "go", "rust"]
#: What shows that a block is code (fixed values).
CONSTRUCTS = [
    r"\bdef\s+\w+\s*\(", r"\bfunction\s+\w+\s*\(", r"\bclass\s+\w+", r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\breturn\s+", r"\bimport\s+\w+", r"console\.log\(", r"print\s*\(", r"SELECT\s+.*FROM", r"INSERT\s+INTO",
    r"<\w+[^>]*>.*</\w+>", r"\w+\s*\{[^}]*\}", r"@\w+", r"=>", r"async\s+", r"await\s+",
]
SHORT_CONSTRUCTS = [r"\bdef\s+", r"\bfunction\s+", r"\breturn\s+", r"\bif\s+", r"\bfor\s+", r"\bwhile\s+", r"print\s*\(", r"console\.", r"=\s*\w+\s*\(", r"\binterface\s+", r"\bclass\s+", r"\btype\s+\w+\s*=", r":\s*(string|number|boolean)"]
TREES, DIAGRAMS = ["├──", "└──", "│", "┌─", "┐", "┘", "└─"], ["flowchart", "graph", "gantt", "pie"]
CODE_SIGNS = ["(", ")", "{", "}", "[", "]", "=", ":", ";", "<", ">"]


def _has(text: Column, words: list[str]) -> Column:
    return any_of([F.contains(text, L(w)) for w in words])


def _matches(text: Column, patterns: list[str], flags: str = "") -> Column:
    return any_of([text.rlike(flags + p) for p in patterns])


def from_content(code: Column) -> Column:
    """The language that the text shows (CD4)."""
    typed = F.contains(code, L(": ")) & _has(code, ["interface ", "type "])
    out = None
    for name, patterns, literals in RULES:
        test = _matches(code, patterns)
        if literals:
            test = test | _has(code, literals)
        if name == "typescript":
            test = test | typed
        value = F.when(_has(code, ["std::", "cout <<", "cin >>"]), "cpp").otherwise("c") if name == "c" else L(name)
        out = F.when(test, value) if out is None else out.when(test, value)
    out = out.when(code.rlike(r"<\w+[^>]*>") & code.rlike(r"</\w+>"), "html")
    out = out.when(code.rlike(r"\w+\s*\{[^}]*\}") & F.contains(code, L(":")) & F.contains(code, L(";")), "css")
    out = out.when(F.startswith(code, L("#!/bin/")) | code.rlike(r"\$\w+") | _has(code, [" && ", " || "]), "shell")
    bare = F.regexp_replace(code, r"^\s+|\s+$", "")
    return out.when(F.startswith(bare, L("{")) & F.endswith(bare, L("}")) & F.contains(code, L('"')) & F.contains(code, L(":")), "json").otherwise("unknown")


def language(hint: Column, code: Column) -> Column:
    """By the hint if it names a language or an alias, else by the text (CD3)."""
    low = F.lower(hint)
    alias = F.create_map(*[L(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.when(low.isin(LANGUAGES), low), F.try_element_at(alias, F.coalesce(low, L(""))), from_content(code))


def fenced_blocks(df: DataFrame, key: str, text: str, least: int = 25) -> DataFrame:
    """``key, block, hint, code``: what stands between the first and second run of three backticks, the third and fourth, ... (CD1).

    The first line is the hint if it has no space and less than 20 characters. Blocks under ``least`` characters and an
    unpaired last run are left out. Blocks are numbered from 1 among those kept.
    """
    parts = F.split(F.col(text), "```")
    rows = df.filter(F.contains(F.col(text), L("```"))).select(F.col(key), F.posexplode(F.slice(parts, L(1), F.size(parts) - 1)).alias("_i", "_part"))
    rows = rows.filter("_i % 2 = 1").select(key, "_i", "_part", F.trim(F.regexp_replace(F.regexp_extract("_part", r"^([^\n]*)\n", 1), r"\s+$", "")).alias("_first"))
    named = (F.col("_first") != "") & ~F.contains("_first", L(" ")) & (F.length("_first") < 20)
    body = F.regexp_replace(F.when(named, F.regexp_replace("_part", r"^[^\n]*\n", "")).otherwise(F.col("_part")), r"^\s+|\s+$", "")
    kept = rows.select(key, "_i", F.when(named, F.col("_first")).otherwise("").alias("hint"), body.alias("code")).filter(F.length("code") >= least)
    return kept.withColumn("block", F.row_number().over(W.partitionBy(key).orderBy("_i")).cast("int")).select(key, "block", "hint", "code")


def valid(code: Column, lang: Column) -> Column:
    """Whether a block is code and not a tree, list, settings or diagram (CD5)."""
    lines = F.filter(F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    n = F.size(lines)
    coded = F.try_divide(F.size(F.filter(lines, lambda x: _has(x, CODE_SIGNS))), n)
    setting = lambda x: x.rlike(r"^[^:]*[^:\s][^:]*:[^:]*[^:\s][^:]*$") & ~_has(x, ["(", ")", "{", "}", ";", "function", "def ", "class ", "if ", "for ", "while "])
    settings = F.try_divide(F.size(F.filter(lines, setting)), n)
    known = lang.isin(DATA)
    construct = _matches(code, CONSTRUCTS, "(?i)") | known
    brief = F.length(code) < 200
    signs = _has(code, ["(", ")", "{", "}", "[", "]", "=", ";"])
    short_lines = F.forall(lines, lambda x: F.size(white_words(x)) < 5)
    coded, settings = F.coalesce(coded, L(1.0)), F.coalesce(settings, L(0.0))
    return (
        F.length(code).between(25, 10000) & F.contains(code, L("\n")) & ~_has(code, TREES) & ~((n >= 3) & (coded < 0.3)) & ~((n > 3) & (settings > 0.8) & ~known) & ~_has(F.lower(code), DIAGRAMS) & construct
        & ~(brief & (~signs | (short_lines & ~_matches(code, SHORT_CONSTRUCTS, "(?i)"))))
    )


def cyclomatic(code: Column) -> Column:
    """One and the decisions, 20 at most (CD11)."""
    return F.least(L(20), total([L(1)] + [F.regexp_count(code, L("(?i)" + p)) for p in DECISIONS]))


def nesting(code: Column, lang: Column) -> Column:
    """Indentation by fours for Python, depth of braces for others (CD10). Closing braces below zero count as zero."""
    indents = F.transform(F.filter(F.split(code, "\n"), lambda x: ~x.rlike(r"^\s*$")), lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^\s+", "")))
    by_indent = F.floor(F.coalesce(F.array_max(indents), L(0)) / 4).cast("int")

    def step(acc: Column, c: Column) -> Column:
        now = F.when(c == "{", acc["now"] + 1).otherwise(F.greatest(L(0), acc["now"] - 1))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    braces = F.aggregate(F.regexp_extract_all(code, L(r"[{}]"), 0), F.struct(L(0).alias("now"), L(0).alias("most")), step, lambda acc: acc["most"])
    return F.when(lang == "python", by_indent).otherwise(braces)


def algorithmic(code: Column) -> Column:
    """0..2: half a point for each kind of control flow up to one, half or one for advanced constructs, cut to whole points (CD7)."""
    control = F.least(L(1.0), total([F.when(code.rlike(p), 0.5).otherwise(0.0) for p in CONTROL]))
    n = total([code.rlike(p).cast("int") for p in ADVANCED])
    return F.least(L(2), F.floor(control + F.when(n >= 3, 1.0).when(n >= 1, 0.5).otherwise(0.0)).cast("int"))


def complexity(code: Column, lang: Column, deep: Column) -> Column:
    """1..10 from length, nesting, control flow and demanding constructs, by family of language (CD6, CD8, CD9)."""
    data, markup = lang.isin(DATA), lang.isin(MARKUP)
    base = F.when(data | markup, 0).otherwise(1)
    share = F.when(data, 0.5).when(markup, 0.7).when(lang == "sql", 0.8).when(lang.isin(PROGRAMS), 1.0).otherwise(0.9)
    n = F.size(F.split(code, "\n"))
    length = F.floor(F.when(n > 50, 3).when(n > 30, 2).when(n > 15, 1).otherwise(0) * share).cast("int")
    nest = F.floor(F.least(L(3), deep) * share).cast("int")
    algo = F.when(lang.isin(PROGRAMS + ["sql"]), algorithmic(code)).otherwise(0)
    hits = None
    for name, patterns in DEMANDING.items():
        own = F.least(L(4), total([code.rlike(p).cast("int") for p in patterns]))
        hits = F.when(lang == name, own) if hits is None else hits.when(lang == name, own)
    objects, arrays = F.regexp_count(code, L(r"\{")) - 1, F.regexp_count(code, L(r"\["))
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json(code)).rlike("^OBJECT"), L(False))
    as_json = F.when(~whole, 0).when((objects > 3) | (arrays > 2), 2).when((objects > 1) | (arrays > 0), 1).otherwise(0)
    lines = F.filter(F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    any_line = lambda p: F.exists(lines, lambda x: x.rlike(p)).cast("int")
    # Lines are stripped before their indentation is looked at, so there is one level at most (known quirk, kept).
    as_yaml = F.least(L(10), 1 + any_line(":") + any_line(r"\[|^-") + any_line(r"[&*]|<<") * 2 + any_line("[|>]") + F.contains(code, L("---")).cast("int"))
    extra = F.when(lang == "json", as_json).when(lang == "yaml", as_yaml).otherwise(0)
    return F.least(L(10), F.greatest(L(1), base + length + nest + algo + hits.otherwise(0) + extra))


def summary(code: Column, lang: Column) -> Column:
    """What a block defines and how many lines it has (CD12)."""
    n = F.concat(L(" with "), F.size(F.split(code, "\n")).cast("string"), L(" lines"))
    name = lambda p: F.regexp_extract(code, p, 1)
    title, script = F.initcap(lang), lang.isin("javascript", "typescript")
    kind = lambda a, p, b: F.concat(a, L(b), name(p), L("'"))
    return (
        F.when((lang == "python") & (name(r"class\s+(\w+)") != ""), F.concat(kind(L("Python"), r"class\s+(\w+)", " class '"), L(" definition"), n))
        .when((lang == "python") & (name(r"def\s+(\w+)") != ""), F.concat(kind(L("Python"), r"def\s+(\w+)", " function '"), n))
        .when(script & (name(r"function\s+(\w+)") != ""), F.concat(kind(title, r"function\s+(\w+)", " function '"), n))
        .when(script & (name(r"const\s+(\w+)\s*=") != ""), F.concat(kind(title, r"const\s+(\w+)\s*=", " constant/function '"), n))
        .otherwise(F.concat(title, L(" code block"), n))
    )


def identifiers(code: Column, lang: Column) -> Column:
    """Names that a block defines or uses, ten at most (CD14)."""
    every = lambda *ps: F.concat(*[F.regexp_extract_all(code, L(p), 1) for p in ps])
    names = F.when(lang == "python", every(r"def\s+(\w+)", r"class\s+(\w+)", r"import\s+(\w+)", r"from\s+(\w+)"))
    names = names.when(lang.isin("javascript", "typescript"), every(r"function\s+(\w+)", r"(?:const|let|var)\s+(\w+)", r"class\s+(\w+)"))
    names = names.when(lang == "java", every(r"class\s+(\w+)", r"(?:public|private|protected)?\s*\w+\s+(\w+)\s*\("))
    names = names.when(lang == "sql", every(r"(?i)FROM\s+(\w+)", r"(?i)JOIN\s+(\w+)"))
    return F.slice(names.otherwise(F.array().cast("array<string>")), 1, 10)


def block_contexts(df: DataFrame, key: str, text: str, least: int = 25, reach: int = 1000) -> DataFrame:
    """The blocks of :func:`fenced_blocks` (CD1) with ``start_line, end_line`` (from 0) and ``before, after``: up to ``reach`` characters around them, stripped."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.split(F.col(text), "```")
    rows = df.filter(F.contains(F.col(text), L("```"))).select(key, parts.alias("_p"), F.explode(F.sequence(L(1), F.size(parts) - 2)).alias("_i")).filter((F.col("_i") % 2 == 1) & (F.col("_i") < F.size("_p") - 1))
    head, part = F.array_join(F.slice("_p", L(1), F.col("_i")), "```"), F.get("_p", F.col("_i"))
    tail = F.array_join(F.slice("_p", F.col("_i") + 2, F.size("_p")), "```")
    first = F.trim(strip(F.regexp_extract(part, r"^([^\n]*)\n", 1)))
    named = (first != "") & ~F.contains(first, L(" ")) & (F.length(first) < 20)
    body = strip(F.when(named, F.regexp_replace(part, r"^[^\n]*\n", "")).otherwise(part))
    rows = rows.select(key, "_i", F.when(named, first).otherwise("").alias("hint"), body.alias("code"), head.alias("_head"), tail.alias("_tail")).filter(F.length("code") >= least)
    lines = lambda c: F.regexp_count(c, L("\n"))
    cut = F.when(F.length("_head") > reach, F.substring(F.col("_head"), -reach, reach)).otherwise(F.col("_head"))
    block = F.row_number().over(W.partitionBy(key).orderBy("_i")).cast("int")
    return rows.select(key, block.alias("block"), "hint", "code", lines(F.col("_head")).alias("start_line"), (lines(F.col("_head")) + lines(F.col("code"))).alias("end_line"), strip(cut).alias("before"), strip(F.substring("_tail", 1, reach)).alias("after"))


def indented_blocks(text: Column) -> Column:
    """CD2: runs of lines that are indented by four blanks or a tab, without that indentation; blank runs are left out."""
    runs = F.regexp_extract_all(F.concat(text, L("\n")), L(r"(?m)((?:^(?:    |\t)[^\n]*\n)+)"), 1)
    bare = F.transform(runs, lambda r: F.regexp_replace(F.regexp_replace(r, r"(?m)^(?:    |\t)", ""), r"^\s+|\s+$", ""))
    return F.filter(bare, lambda r: r != "")


def context_headers(before: Column, after: Column) -> Column:
    """CD16: the headers around a block as ``h2: Title``, first those of ``before`` and ``after`` each twice (as they stand and with lines stripped), five at most."""
    stripped = lambda c: F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "\n")

    def own(c: Column) -> Column:
        named = F.regexp_extract_all(c, L(r"(?m)^(#+[ \t]+[^\n]+)$"), 1)
        return F.transform(named, lambda x: F.concat(L("h"), F.length(F.regexp_extract(x, "^(#+)", 1)).cast("string"), L(": "), F.regexp_replace(F.regexp_extract(x, r"^#+\s+(.*)$", 1), r"^\s+|\s+$", "")))

    return F.slice(F.concat(own(before), own(stripped(before)), own(after), own(stripped(after))), 1, 5)


def block_metadata(code: Column, lang: Column, before: Column, after: Column) -> dict[str, Column]:
    """CD17: what is stored beside a block, but for its own columns."""
    lines, names = F.split(code, "\n"), identifiers(code, lang)
    filled, words = F.size(F.filter(lines, lambda x: ~x.rlike(r"^\s*$"))), F.size(white_words(code))
    return {
        "context_before": F.when(F.length(before) > 500, F.substring(before, -500, 500)).otherwise(before), "context_after": F.substring(after, 1, 500), "char_count": F.length(code), "word_count": words, "line_count": F.size(lines),
        "non_empty_line_count": filled, "code_density": F.round(filled / F.size(lines), 2), "identifiers": names, "has_comments": code.rlike(r"#|//|/\*|\*/|\'\'\'|\"\"\""), "has_strings": code.rlike("[\"']"),
        "has_loops": code.rlike(r"(?i)\b(?:for|while|do)\b"), "has_conditions": code.rlike(r"(?i)\b(?:if|else|elif|switch|case)\b"), "surrounding_headers": context_headers(before, after),
        "reading_minutes": F.greatest(L(1), F.floor(words / 200).cast("int")), "nesting": nesting(code, lang), "cyclomatic": cyclomatic(code), "unique_identifiers": F.size(F.array_distinct(names)),
    }
