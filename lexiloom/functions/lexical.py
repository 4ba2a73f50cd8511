"""Tokenisers and the stemmer as column expressions; nothing here runs Python on a row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no evidence in a statement.
STOPWORDS = """
a an the of to in for on with and or is are be by that this it its as at from
we if then such let there exists all any some not no non into over under between each
which where when whose given only also more most other another same both either
theorem lemma proposition corollary definition proof shows show gives give see cf
version case cases form type term expression statement result note true false
i e g eg ie etc via using used use uses can may must should would could will
one two three main special general simple standard usual natural basic
""".split()

# Words whose stem no rule gives.
IRREGULAR = {
    "series": "series", "bases": "basis", "basis": "basis",
    "indices": "index", "index": "index", "vertices": "vertex",
    "matrices": "matrix", "radii": "radius", "foci": "focus",
    "lemmas": "lemma", "formulae": "formula", "maxima": "max",
    "minima": "min", "polyhedra": "polyhedron", "simplices": "simplex",
    "ideals": "ideal", "analysis": "analysis", "hypothesis": "hypothesis",
}

# Endings and what takes their place, in the order in which they are tried.
ENDINGS = (
    ("ications", "ic"), ("ication", "ic"), ("izations", "ize"), ("ization", "ize"), ("ations", "ate"), ("ation", "ate"),
    ("iveness", "ive"), ("ness", ""), ("ilities", "ile"), ("ility", "ile"), ("ities", "ity"), ("ically", "ic"), ("ally", "al"),
    ("ly", ""), ("ies", "y"), ("ings", "ing"), ("ing", ""), ("edly", ""), ("ed", ""),
)

# Words of a declaration's head that are syntax.
HEAD_SYNTAX = """
inst Type Sort Prop theorem lemma def abbrev structure class instance axiom
example where fun let have match with deriving extends protected private
noncomputable partial unsafe mutual do then else if at using by exact intro
""".split()

# Parts of module paths that say nothing.
MODULE_NOISE = ("mathlib", "basic", "defs", "lemmas")


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def stem_sql(word: str) -> str:
    """DuckDB SQL for :func:`stem` of ``word``, a lower-case expression.

    An ending is replaced only if four characters are left; else the next one is tried.
    """
    w = f"trim({word}, '-')" if " " not in word else word
    cases = [f"when {w} = '{a}' then '{b}'" for a, b in IRREGULAR.items()]
    cases.append(f"when length({w}) <= 3 then {w}")
    for end, new in ENDINGS:
        cases.append(f"when right({w}, {len(end)}) = '{end}' and length({w}) >= {4 + len(end) - len(new)} then concat(left({w}, length({w}) - {len(end)}), '{new}')")
    cases.append(f"when right({w}, 1) <> 's' or right({w}, 2) in ('ss', 'us', 'is', 'os', 'as') then {w}")
    cases.append(f"when right({w}, 3) in ('ses', 'xes', 'zes') or right({w}, 4) in ('ches', 'shes') then left({w}, length({w}) - 2)")
    return f"case {' '.join(cases)} else left({w}, length({w}) - 1) end"


def _stemmed(w: Column) -> Column:
    out = F
    for a, b in IRREGULAR.items():
        out = out.when(w == a, b)
    out = out.when(F.length(w) <= 3, w)
    for end, new in ENDINGS:
        out = out.when(w.endswith(end) & (F.length(w) >= 4 + len(end) - len(new)), F.concat(F.left(w, F.length(w) - len(end)), F.lit(new)))
    any_end = lambda *ends: reduce(or_, [w.endswith(e) for e in ends])
    out = out.when(~w.endswith("s") | any_end("ss", "us", "is", "os", "as"), w)
    out = out.when(any_end("ses", "xes", "zes", "ches", "shes"), F.left(w, F.length(w) - 2))
    return out.otherwise(F.left(w, F.length(w) - 1))


def stem(word: Column) -> Column:
    """Lower-cased, hyphens at the ends removed, stemmed. Null stays null.

    The cleaned word is bound once: every branch names it, and inside a lambda nothing is shared.
    """
    return F.transform(F.array(F.btrim(F.lower(word), F.lit("-"))), _stemmed)[0]


def identifier_words(name: Column) -> Column:
    """An identifier's words: cut at dots, underscores, primes and case changes, lower-cased."""
    spaced = F.regexp_replace(name, "[._']+", " ")
    spaced = F.regexp_replace(spaced, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.array_remove(F.split(F.regexp_replace(F.lower(spaced), "[^a-z0-9 ]", ""), " +"), "")


def module_words(module: Column) -> Column:
    return F.filter(identifier_words(module), lambda w: ~w.isin(*MODULE_NOISE))


def head_words(head: Column, elaborated: Column | bool = False) -> Column:
    """Identifier words of a declaration's type; a scraped head ends at its first ``:=``."""
    body = F.when(F.lit(elaborated) if isinstance(elaborated, bool) else elaborated, head).otherwise(F.substring_index(head, ":=", 1))
    found = F.filter(F.regexp_extract_all(body, F.lit("[A-Za-z][A-Za-z0-9_']*"), 0), lambda w: (F.length(w) > 1) & ~w.isin(*HEAD_SYNTAX) & ~w.rlike("^u_?[0-9]+$"))
    return F.flatten(F.transform(found, identifier_words))


def raw_prose_words(text: Column) -> Column:
    """Lower-case words of two or more letters, without code, formulas, stopwords and words under three characters."""
    prose = F.regexp_replace(F.regexp_replace(text, "`[^`]*`", " "), "\\$[^$]*\\$", " ")
    found = F.transform(F.regexp_extract_all(prose, F.lit("[A-Za-z][A-Za-z\\-]+"), 0), F.lower)
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))


def prose_words(text: Column) -> Column:
    """Stems of the words of running text, in order, repeats kept."""
    return F.transform(raw_prose_words(text), stem)


def prose_word_set(text: Column) -> Column:
    """The distinct stems of running text; each distinct word is stemmed once."""
    return F.array_distinct(F.transform(F.array_distinct(raw_prose_words(text)), stem))


def prose_words_sql(text: str) -> str:
    """DuckDB SQL for :func:`prose_words`."""
    prose = f"regexp_replace(regexp_replace({text}, '`[^`]*`', ' ', 'g'), '\\$[^$]*\\$', ' ', 'g')"
    raw = f"list_filter(list_transform(regexp_extract_all({prose}, '[A-Za-z][A-Za-z\\-]+'), lambda w: lower(w)), lambda w: length(w) >= 3 and w not in ({_quoted(STOPWORDS)}))"
    return f"list_transform({raw}, lambda w: {stem_sql('w')})"


def identifier_words_sql(name: str) -> str:
    """DuckDB SQL for :func:`identifier_words`; RE2 has no look-around, so boundaries are inserted in passes."""
    s = f"regexp_replace({name}, '[._'']+', ' ', 'g')"
    s = f"regexp_replace({s}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(regexp_replace(lower({s}), '[^a-z0-9 ]', '', 'g'), ' +'), lambda w: w <> '')"


def draw(*parts: Column | str) -> Column:
    """A reproducible number below 2^60 of the texts of the parts, which SQL engines give alike."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """DuckDB SQL for :func:`draw` of SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::bigint"


def head_words_sql(head: str) -> str:
    """DuckDB SQL for :func:`head_words` of a scraped head."""
    found = f"list_filter(regexp_extract_all(string_split({head}, ':=')[1], '[A-Za-z][A-Za-z0-9_'']*'), lambda w: length(w) > 1 and w not in ({_quoted(HEAD_SYNTAX)}) and not regexp_matches(w, '^u_?[0-9]+$'))"
    return f"flatten(list_transform({found}, lambda w: {identifier_words_sql('w')}))"
