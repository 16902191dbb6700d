"""The driver's queries for the template parsers: records with templates built from parts, read by the parsers, and SQL that says what they claim.

An expression over s (size), n (name), t (type), l (language) and m (the next
language) means the same in both dialects.  Language codes and terms are left
out, unknown or invalid for some sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.operators import claims
from lexigraph.plans.queries import ORACLES, QUERIES, langs_of, table
from lexigraph.runtime import spread
from lexigraph.sources.langs import Langs

_PARTS = "p AS (SELECT p_partkey AS item_id, p_size AS s, p_name AS n, p_type AS t, p_size % 6 AS l, (p_size + 1) % 6 AS m FROM part)"
#: A template's language of its own item, wrong for every seventh size; another language, unknown for every fourth; a term, invalid for every eleventh.
OWN, OTHER, TERM = "CASE WHEN s % 7 = 0 THEN 'l9' ELSE 'l' || l END", "CASE WHEN s % 4 = 0 THEN 'zz' ELSE 'l' || m END", "CASE WHEN s % 11 = 0 THEN '-' ELSE n END"
OWN_OK, OTHER_OK, TERM_OK = "s % 7 <> 0", "s % 4 <> 0", "s % 11 <> 0"


def pick(names: list[str | None]) -> str:
    return f"CASE s % {len(names)} " + " ".join(f"WHEN {k} THEN {'NULL' if n is None else repr(n)}" for k, n in enumerate(names)) + " END"


def template(name: str, **args: str) -> str:
    """A template as Spark SQL: its name and arguments (a1 is '1') are expressions; a null argument isn't there."""
    pairs = ", ".join(f"'{k.removeprefix('a') if k[1:].isdigit() else k}', cast({v} AS string)" for k, v in args.items())
    return f"named_struct('name', {name}, 'args', map_filter(map({pairs}), (k, x) -> x IS NOT NULL))"


def _items(spark: SparkSession, d: str, record: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey AS item_id", "p_size AS s", "p_name AS n", "p_type AS t", "p_size % 6 AS l", "(p_size + 1) % 6 AS m")
    rows = spread(rows, "item_id")
    return rows.selectExpr("item_id", "'l' || l AS code", "cast(l AS int) AS lang_id", f"parse_json(to_json({record})) AS v")


def _langs(spark: SparkSession) -> Langs:
    langs = langs_of(spark)
    codes = [(f"l{n}", n) for n in range(6)] + [(f"l{n}-pro", n) for n in range(6)] + [("ine-pro", 5)]
    return Langs(langs, spark.createDataFrame(codes, "code string, lang_id int"), langs.select("name", "lang_id"))


def register(name: str, run: Callable[[SparkSession, str], DataFrame], selects: list[str]) -> None:
    QUERIES[name] = run
    ORACLES[name] = f"WITH {_PARTS} " + " UNION ALL ".join(selects)


def etymology(name: str, record: str, *expected: tuple[str, ...]) -> None:
    """expected: of each claim (nth, ok, mode, head, terms), and where it is."""

    def run(spark, d):
        rows = claims.etymologies(_items(spark, d, record), _langs(spark)).select("item_id", F.explode("claims").alias("c"))
        terms = F.concat_ws("|", F.transform("c.terms", lambda x: F.concat(x["lang_id"].cast("string"), F.lit(":"), x["term"])))
        return rows.select("item_id", "c.nth", "c.ok", "c.mode", "c.head", F.when(F.col("c.ok"), terms).alias("terms"))

    register(name, run, [f"SELECT item_id, {nth} AS nth, {ok} AS ok, CASE WHEN {ok} THEN {mode} END AS mode, CASE WHEN {ok} THEN {head} END AS head, CASE WHEN {ok} THEN {terms} END AS terms FROM p WHERE {'true' if not where else where[0]}" for nth, ok, mode, head, terms, *where in expected])


def _templates(*every: str) -> str:
    return f"named_struct('etymology_templates', array({', '.join(every)}))"


def all_of(*conditions: str) -> str:
    return " AND ".join(f"({c})" for c in conditions)


_OWN_TERM = "l || ':' || n"
_OTHER_TERM = "m || ':' || n"

etymology(
    "parse_derived",
    _templates(template(pick(["der", "inh-lite", "bor", "lbor", "clq", "foo"]), a1=OWN, a2=f"({OTHER}) || ',l0'", a3="CASE WHEN s % 11 = 0 THEN '*-' ELSE '*' || n || ' (sense)' END")),
    ("0", all_of(OWN_OK, OTHER_OK, TERM_OK, "s % 6 <> 5"), pick(["derived", "inherited", "borrowed", "learned borrowing", "calque", None]), "0", _OTHER_TERM),
)
etymology(
    "parse_abbreviation",
    _templates(template(pick(["clipping", "abbrev", "acronym", "contr", "rdp"]), a1=OWN, a2=TERM)),
    ("0", all_of(OWN_OK, TERM_OK), pick(["clipping", "abbreviation", "acronym", "contraction", "reduplication"]), "0", _OWN_TERM),
)
etymology(
    "parse_prefix",
    _templates(template(pick(["prefix", "pre"]), a1=OWN, a2="CASE WHEN s % 3 = 0 THEN t ELSE t || '-' END", a3=TERM)),
    ("0", all_of(OWN_OK, TERM_OK), "'prefix'", "1", f"l || ':' || t || '-|' || {_OWN_TERM}"),
)
etymology(
    "parse_suffix",
    _templates(template(pick(["suffix", "suf"]), a1=OWN, a2=TERM, a3="CASE WHEN s % 3 = 0 THEN t ELSE '-' || t END")),
    ("0", all_of(OWN_OK, TERM_OK), "'suffix'", "0", f"{_OWN_TERM} || '|' || l || ':-' || t"),
)
etymology(
    "parse_circumfix",
    _templates(template("'circumfix'", a1=OWN, a2="t", a3=TERM, a4="CASE WHEN s % 13 = 0 THEN NULL ELSE 'y' || l END")),
    ("0", all_of(OWN_OK, TERM_OK, "s % 13 <> 0"), "'circumfix'", "0", f"{_OWN_TERM} || '|' || l || ':' || t || '- -y' || l"),
)
etymology(
    "parse_infix",
    _templates(template("'infix'", a1=OWN, a2=TERM, a3="CASE s % 3 WHEN 0 THEN t WHEN 1 THEN '-' || t ELSE '-' || t || '-' END")),
    ("0", all_of(OWN_OK, TERM_OK), "'infix'", "0", f"{_OWN_TERM} || '|' || l || ':-' || t || '-'"),
)
etymology(
    "parse_confix",
    _templates(template(pick(["confix", "con"]), a1=OWN, a2="t", a3=TERM, a4="CASE WHEN s % 3 = 0 THEN NULL ELSE 'y' || l END")),
    ("0", all_of(OWN_OK, TERM_OK), "'confix'", "CASE WHEN s % 3 <> 0 THEN 1 END", "CASE WHEN s % 3 = 0 THEN l || ':' || t || '-|' || l || ':-' || n ELSE l || ':' || t || '-|' || l || ':' || n || '|' || l || ':-y' || l END"),
)
etymology(
    "parse_compound",
    _templates(template(pick(["com", "univ", "blend", "compound"]), a1=OWN, a2="n", a3="t", lang3=f"CASE WHEN s % 3 = 0 THEN NULL ELSE {OTHER} END", a4="CASE WHEN s % 5 = 0 THEN 'z' ELSE '-' END", a5="'never'")),
    ("0", all_of(OWN_OK, f"s % 3 = 0 OR {OTHER_OK}"), pick(["compound", "univerbation", "blend", "compound"]), "CASE WHEN false THEN 0 END", f"{_OWN_TERM} || '|' || CASE WHEN s % 3 = 0 THEN l ELSE m END || ':' || t || CASE WHEN s % 5 = 0 THEN '|' || l || ':z|' || l || ':never' ELSE '' END"),
)
etymology(
    "parse_affix",
    _templates(template(pick(["af", "affix"]), a1=OWN, a2="CASE WHEN s % 3 = 1 THEN t ELSE t || '-' END", a3="CASE WHEN s % 3 = 0 THEN n ELSE '-' || n END")),
    ("0", OWN_OK, pick(["prefix", "suffix", "confix"]), "CASE s % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END", "l || ':' || t || CASE WHEN s % 3 = 1 THEN '' ELSE '-' END || '|' || l || ':' || CASE WHEN s % 3 = 0 THEN '' ELSE '-' END || n"),
)
etymology(
    "parse_vrddhi",
    _templates(template(pick(["vrd", "vrddhi-ya"]), a1=OTHER, a2=TERM)),
    ("0", all_of(OTHER_OK, TERM_OK), pick(["vṛddhi", "vṛddhi-ya"]), "0", _OTHER_TERM),
)
_MENTION = template(pick(["m", "mention"]), a1=OTHER, a2=TERM)
_ROOT = template("'root'", a1=OWN, a2=OTHER)
etymology(
    "parse_single_mention",
    _templates(_ROOT, _MENTION),
    ("0", all_of(OTHER_OK, TERM_OK), "'mention'", "0", _OTHER_TERM),
    ("1", "false", "''", "0", "''", f"NOT ({all_of(OTHER_OK, TERM_OK)})"),
)
etymology(
    "parse_standard",
    _templates(template("'der'", a1=OWN, a2=OTHER, a3=TERM), template("'foo'", a1=OWN), template("'suf'", a1=OWN, a2="n", a3="t")),
    ("0", all_of(OWN_OK, OTHER_OK, TERM_OK), "'derived'", "0", _OTHER_TERM),
    ("1", "false", "''", "0", "''"),
    ("2", OWN_OK, "'suffix'", "0", f"{_OWN_TERM} || '|' || l || ':-' || t"),
)
_SENSES = "'senses', filter(array(named_struct('alt_of', CASE WHEN s % 2 = 0 THEN array(named_struct('word', n)) END, 'form_of', array(named_struct('word', t || '-')))), x -> s % 5 <> 0)"
_FORM = ("'form'", "0", "l || ':' || CASE WHEN s % 2 = 0 THEN n ELSE t || '-' END")
etymology("parse_form", f"named_struct({_SENSES})", ("0", "true", *_FORM, "s % 5 <> 0"))
etymology(
    "parse_choice",
    f"named_struct('etymology_templates', filter(array({_MENTION}, {template(repr('pre'), a1=OWN, a2='t', a3='n')}), (x, k) -> s % 3 = k), {_SENSES})",
    ("0", all_of(OTHER_OK, TERM_OK), "'mention'", "0", _OTHER_TERM, "s % 3 = 0"),
    ("0", OWN_OK, "'prefix'", "1", f"l || ':' || t || '-|' || {_OWN_TERM}", "s % 3 = 1"),
    ("0", "true", *_FORM, "s % 3 = 2 AND s % 5 <> 0"),
)


def root(name: str, record: str, *expected: tuple[str, str, str, str]) -> None:
    """expected: (lang_id, term, sense) and where it is."""
    run = lambda spark, d: claims.roots(_items(spark, d, record), _langs(spark))
    register(name, run, [f"SELECT item_id, {lang}::INTEGER AS lang_id, {term} AS term, {sense} AS sense FROM p WHERE {where}" for lang, term, sense, where in expected])


_NONE = "NULL::VARCHAR"
root(
    "parse_root_template",
    _templates(template("CASE WHEN s % 5 = 0 THEN 'word' ELSE 'root' END", a1=OWN, a2=OTHER, a3=f"({TERM}) || CASE WHEN s % 2 = 0 AND s % 11 <> 0 THEN ' (one)' ELSE '' END", a4="CASE WHEN s % 13 = 0 THEN 'more' END", id="CASE WHEN s % 3 = 0 THEN 'two' END")),
    ("m", "n", "CASE WHEN s % 2 = 0 THEN 'one' WHEN s % 3 = 0 THEN 'two' END", all_of(OWN_OK, OTHER_OK, TERM_OK, "s % 13 <> 0")),
)
root("parse_ancient_word", _templates(template("'PIE word'", a1=OWN, a2=TERM)), ("5", "n", _NONE, all_of(OWN_OK, TERM_OK)))
_READABLE = template("'root'", a1="'l' || l", a2="'l' || m", a3="n")
_CATEGORY = "'Lang ' || CASE WHEN s % 4 = 0 THEN 9 ELSE l END || ' terms derived from the Lang ' || m || ' root *' || t || ' (sn)'"
root(
    "parse_root_choice",
    f"named_struct('etymology_templates', filter(array({template(repr('root'), a1=repr('l') + ' || l', a2=repr('l') + ' || m', a3='n', a4='n')}, {_READABLE}), (x, k) -> CASE s % 3 WHEN 0 THEN true WHEN 1 THEN k = 1 ELSE false END), "
    f"'categories', array('Lemmas', {_CATEGORY}, 'Lang ' || l || ' terms derived from the Lang 0 root *other'))",
    ("m", "n", _NONE, "s % 3 = 1"),
    ("CASE WHEN s % 4 = 0 THEN 0 ELSE m END", "CASE WHEN s % 4 = 0 THEN 'other' ELSE t END", "CASE WHEN s % 4 <> 0 THEN 'sn' END", "s % 3 = 2"),
)


def line(*templates: str, depth: str = "1", text: str = "cast(NULL AS string)", tags: str = "cast(array() AS array<string>)") -> str:
    every = f"array({', '.join(templates)})" if templates else f"filter(array({template(repr('x'), a1=repr('x'))}), x -> false)"
    return f"named_struct('depth', {depth}, 'text', {text}, 'tags', {tags}, 'templates', {every})"


def descendants(name: str, lines: list[str], *expected: tuple[str, ...]) -> None:
    """expected: of each line (nth, depth, kind, language, terms as term~mode), and where it is."""
    record = f"named_struct('descendants', array({', '.join(lines)}))"

    def run(spark, d):
        rows = _items(spark, d, record).select("item_id", F.lit(0).cast("long").alias("line_no"), "v")
        found = claims.descendants(rows, _langs(spark)).select("item_id", F.explode("lines").alias("x"))
        terms = F.concat_ws("|", F.transform("x.terms", lambda y: F.concat(y["term"], F.lit("~"), y["mode"])))
        return found.select("item_id", "x.nth", "x.depth", "x.kind", "x.lang_id", F.when(F.col("x.terms").isNotNull(), terms).alias("terms"))

    register(name, run, [f"SELECT item_id, {nth} AS nth, {depth} AS depth, {kind} AS kind, CASE WHEN {kind} IN ('desc', 'lang') THEN {lang} END::INTEGER AS lang_id, CASE WHEN {kind} = 'desc' THEN {terms} END AS terms FROM p WHERE {'true' if not where else where[0]}" for nth, depth, kind, lang, terms, *where in expected])


_DESC = template("'desc'", a1=OTHER, a2="n")
_READ = "s % 5 <> 0"
_LINES = [line(text="'some text'", depth="CASE WHEN s % 5 = 0 THEN 300 ELSE 1 END"), line(template(pick(["desc", "descendant"]), a1=OTHER)), line(_DESC, template("'desc'", a1=OTHER, a2="t"), depth="2"), line(_DESC, template("'desc'", a1="'l0'", a2="t"), depth="2"), line(depth="3")]
descendants("parse_descendants_list", _LINES, ("0", "1", "'text'", "0", "''", _READ), *[(str(k), str(dep), kind, "m", terms, _READ) for k, dep, kind, terms in (
    (1, 1, f"CASE WHEN {OTHER_OK} THEN 'lang' ELSE 'other' END", "''"),
    (2, 2, f"CASE WHEN {OTHER_OK} THEN 'desc' ELSE 'other' END", "n || '~inherited|' || t || '~inherited'"),
    (3, 2, f"CASE WHEN NOT ({OTHER_OK}) OR m = 0 THEN 'desc' ELSE 'other' END", f"CASE WHEN {OTHER_OK} THEN n || '~inherited|' ELSE '' END || t || '~inherited'"),
    (4, 3, "'other'", "''"),
)])
# a line that only its own language's unknown code is missing from is of the other one
ORACLES["parse_descendants_list"] = ORACLES["parse_descendants_list"].replace("CASE WHEN CASE WHEN NOT (s % 4 <> 0) OR m = 0 THEN 'desc' ELSE 'other' END IN ('desc', 'lang') THEN m END", "CASE WHEN NOT (s % 4 <> 0) OR m = 0 THEN 0 END")
_KNOWN = f"CASE WHEN {OTHER_OK} THEN 'desc' ELSE 'other' END"
descendants(
    "parse_line_dispatch",
    [line(template(pick(["desc", "l", "desctree", "foo"]), a1="'l' || m", a2="n"))],
    ("0", "1", "CASE WHEN s % 4 = 3 THEN 'other' ELSE 'desc' END", "m", "n || CASE WHEN s % 4 = 1 THEN '~derived' ELSE '~inherited' END"),
)
descendants(
    "parse_desc",
    [line(template(pick(["desc", "descendant"]), a1=OTHER, a2="CASE WHEN s % 3 = 0 THEN '' ELSE n END", alt="'A' || l", a3="CASE WHEN s % 2 = 0 THEN '-' ELSE t END", a4="'z'"))],
    ("0", "1", _KNOWN, "m", "CASE WHEN s % 3 = 0 THEN 'A' || l ELSE n END || '~inherited' || CASE WHEN s % 2 = 0 THEN '' ELSE '|' || t || '~inherited|z~inherited' END"),
)
descendants(
    "parse_link",
    [line(template(pick(["l", "link"]), a1=OTHER, a2="CASE WHEN s % 3 = 0 THEN NULL ELSE n END", a3="t"), tags="CASE WHEN s % 5 = 0 THEN array('x', 'derived') ELSE array('x') END")],
    ("0", "1", _KNOWN, "m", "CASE WHEN s % 3 = 0 THEN t ELSE n END || CASE WHEN s % 5 = 0 THEN '~morphological derivation' ELSE '~derived' END"),
)
descendants(
    "parse_desctree",
    [line(template(pick(["desctree", "descendants tree"]), a1=OTHER, a2=TERM, a3="t", bor="CASE WHEN s % 3 = 0 THEN '1' END"))],
    ("0", "1", f"CASE WHEN {all_of(OTHER_OK, TERM_OK)} THEN 'desc' ELSE 'other' END", "m", "n || CASE WHEN s % 3 = 0 THEN '~borrowed' ELSE '~inherited' END"),
)
descendants(
    "parse_descendant_modes",
    [line(template("'desc'", a1="'l' || m", a2="n", a3="t", bor="CASE WHEN s % 4 = 0 THEN '1' END", clq2="CASE WHEN s % 4 = 1 THEN '1' END", slb1="CASE WHEN s % 4 = 2 THEN '1' END", lbor="CASE WHEN s % 8 = 0 THEN '1' END"))],
    ("0", "1", "'desc'", "m", "n || CASE s % 4 WHEN 0 THEN '~borrowed|' WHEN 2 THEN '~semi-learned borrowing|' ELSE '~inherited|' END || t || CASE s % 4 WHEN 0 THEN '~borrowed' WHEN 1 THEN '~calque' ELSE '~inherited' END"),
)
