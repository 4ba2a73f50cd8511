"""LaTeX mark-up as column expressions: comments, formulas, prose and macros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as mark-up.
FORMULAS = (
    r"(?s)\\\[(.*?)\\\]",
    r"(?s)\$\$(.*?)\$\$",
    r"\$([^$]*)\$",
    r"(?s)\\begin\{(?:equation|align|gather|multline)\*?\}(.*?)\\end\{(?:equation|align|gather|multline)\*?\}",
)
LABEL = r"\\label\{([^}]+)\}"
REFERENCE = r"\\(?:auto|c|C|eq|name|v)?ref\*?\{([^}]+)\}"
CITATION = r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]+)\}"
SECTION = r"\\(?:sub){0,2}section\*?\{([^}]*)\}"
USES = r"\\uses\{([^}]*)\}"
DECLARED = r"\\lean\{([^}]*)\}"
CHECKED = r"\\leanok\b"
STYLED = r"\\(?:emph|textit|textbf|texttt|mathrm|text)\{([^}]*)\}"


def without_comments(source: Column) -> Column:
    """Cut every line at its first percent sign that no backslash escapes."""
    return F.regexp_replace(source, r"(?m)^((?:[^%\\\n]|\\.|\\$)*)%.*$", "$1")


def formulas(text: Column) -> Column:
    """The bodies of all formulas, kind by kind, trimmed, none empty. One inside another is found twice."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in FORMULAS])
    return F.filter(F.transform(found, lambda m: F.regexp_replace(m, r"^\s+|\s+$", "")), lambda m: m != "")


# What becomes of mark-up in running text, in this order, after formulas.
CLEANED = (
    (LABEL, " "), (CITATION, " "), (REFERENCE, " REF "), (USES, " "), (DECLARED, " "), (STYLED, "$1"), (r"\\[a-zA-Z@]+\*?", " "), (r"[{}~\\]", " "), (r"\s+", " "),
)


def prose(text: Column) -> Column:
    """Running text: formulas become MATH, references REF, other mark-up goes."""
    for p, new in (*((f, " MATH ") for f in FORMULAS), *CLEANED):
        text = F.regexp_replace(text, p, new)
    return F.trim(text)


def _pattern_sql(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def prose_sql(text: str) -> str:
    """DuckDB SQL for :func:`prose`."""
    for p, new in (*((f, " MATH ") for f in FORMULAS), *CLEANED):
        text = f"regexp_replace({text}, {_pattern_sql(p)}, '{new.replace('$1', chr(92) + '1')}', 'g')"
    return f"trim({text}, ' ')"


def formulas_sql(text: str) -> str:
    """DuckDB SQL for :func:`formulas`."""
    found = ", ".join(f"regexp_extract_all({text}, {_pattern_sql(p)}, 1)" for p in FORMULAS)
    return f"list_filter(list_transform(flatten([{found}]), lambda m: regexp_replace(m, '^\\s+|\\s+$', '', 'g')), lambda m: m <> '')"


def names_in(text: Column, macro: str) -> Column:
    """Sorted distinct names in a macro's comma-separated arguments, none empty."""
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(macro), 1), lambda g: F.split(g, ",")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda n: F.trim(n)), lambda n: n != "")))


# The concepts of commands and of signs, commands that only set type, prefixes of fonts.
COMMANDS = {
    "leq": "le", "geq": "ge", "le": "le", "ge": "ge", "neq": "ne", "ne": "ne",
    "cdot": "mul", "times": "mul", "frac": "div", "sum": "sum", "prod": "prod",
    "log": "log", "exp": "exp", "sqrt": "sqrt", "inf": "inf", "sup": "sup",
    "min": "min", "max": "max", "lim": "tendsto", "int": "integral",
    "subseteq": "subset", "subset": "subset", "in": "mem", "cup": "union",
    "cap": "inter", "setminus": "sdiff", "emptyset": "empty",
    "forall": "forall", "exists": "exists", "mapsto": "map", "to": "map",
    "circ": "comp", "otimes": "tensor", "oplus": "sum", "langle": "inner",
    "norm": "norm", "abs": "abs", "floor": "floor", "ceil": "ceil",
}
SIGNS = {"=": "eq", "<": "lt", ">": "gt", "+": "add", "-": "sub", "*": "mul", "/": "div", "!": "factorial"}
TYPESETTING = """
left right big bigg Big Bigg quad qquad mathrm mathbf mathcal mathbb mathfrak mathsf text textrm operatorname
limits nolimits displaystyle label notag nonumber begin end item cref ref eqref hspace vspace phantom dots ldots
cdots vdots ddots prime
""".split()
FONTS = ("bb", "bf", "cal", "frak", "sf", "rm", "var", "wide", "over")


def symbol_bag(segments: Column) -> Column:
    """What formulas name, repeats kept: concepts of commands and signs, else a command's letters, and application."""
    concept = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])

    def one(segment: Column) -> Column:
        commands = F.filter(F.regexp_extract_all(segment, F.lit("\\\\([a-zA-Z]+)"), 1), lambda c: ~c.isin(*TYPESETTING))
        named = F.transform(commands, lambda c: F.coalesce(F.try_element_at(concept, c), F.lower(F.regexp_replace(c, f"^({'|'.join(FONTS)})(?=.)", ""))))
        rest = F.regexp_replace(segment, "\\\\[a-zA-Z]+", " ")
        signs = F.array(*[F.when(F.contains(rest, F.lit(sign)), F.lit(name)) for sign, name in SIGNS.items()])
        applied = F.array(F.when(F.contains(segment, F.lit("[")) & F.contains(segment, F.lit("]")), F.lit("apply")))
        return F.filter(F.concat(named, signs, applied), lambda c: c.isNotNull() & F.length(c).between(1, 12))

    return F.transform(F.flatten(F.transform(segments, one)), lambda c: F.concat(F.lit("m:"), c))


def symbol_bag_sql(segments: str) -> str:
    """DuckDB SQL for :func:`symbol_bag` of a list of segments."""
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    concept = f"map([{listed(COMMANDS)}], [{listed(COMMANDS.values())}])"
    commands = f"list_filter(regexp_extract_all(g, '\\\\([a-zA-Z]+)', 1), lambda c: c not in ({listed(TYPESETTING)}))"
    named = f"list_transform({commands}, lambda c: coalesce({concept}[c], lower(regexp_replace(c, '^(?:{'|'.join(FONTS)})(.)', '\\1'))))"
    rest = "regexp_replace(g, '\\\\[a-zA-Z]+', ' ', 'g')"
    signs = ", ".join(f"case when contains({rest}, '{sign}') then '{name}' end" for sign, name in SIGNS.items())
    one = f"list_filter(list_concat({named}, [{signs}], [case when contains(g, '[') and contains(g, ']') then 'apply' end]), lambda c: c is not null and length(c) between 1 and 12)"
    return f"list_transform(flatten(list_transform({segments}, lambda g: {one})), lambda c: 'm:' || c)"
