"""From parsed records to items and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigraph.functions.modes import known_pos
from lexigraph.functions.text import reconstruction_title, valid, valid_term
from lexigraph.runtime import dense_ids, materialize
from lexigraph.sources.dump import field, strict_byte, strict_string
from lexigraph.sources.langs import Langs

NAMESPACES = ("Index", "Help", "MediaWiki", "Citations", "Concordance", "Rhymes", "Thread", "Summary", "File", "Transwiki", "Category", "Appendix", "Wiktionary", "Thesaurus", "Module", "Template")
_FORMS = "array<struct<form:variant,tags:array<variant>>>"


def _strings(tags: Column) -> Column:
    return F.transform(tags, strict_string)


def no_comma(c: Column) -> Column:
    return F.when(~c.contains(","), c)


def page_term(v: str) -> Column:
    return no_comma(valid(strict_string(field(v, "word"))))


def canonical_term(v: str) -> Column:
    """The first form tagged as canonical whose term is valid; else the page's. A form's tags count up to the first that isn't a string."""

    def tagged(form: Column) -> Column:
        tags = _strings(form["tags"])
        bad = F.array_position(F.transform(tags, lambda t: t.isNull()), F.lit(True))
        read = F.when(bad == 0, tags).otherwise(F.slice(tags, 1, F.greatest(bad - 1, F.lit(0)).cast("int")))
        return F.coalesce(F.array_contains(read, "canonical"), F.lit(False))

    terms = F.transform(F.filter(field(v, "forms", _FORMS), tagged), lambda f: no_comma(valid_term(strict_string(f["form"]))))
    return F.coalesce(F.get(F.filter(terms, lambda t: t.isNotNull()), 0), page_term(v))


def romanization(v: str) -> Column:
    """The term of the first form tagged as a romanization, valid or not."""
    forms = F.filter(field(v, "forms", _FORMS), lambda f: F.coalesce(F.exists(_strings(f["tags"]), lambda t: t == "romanization"), F.lit(False)))
    return valid_term(strict_string(F.get(forms, 0)["form"]))


def first_gloss(v: str) -> Column:
    return F.nullif(strict_string(F.try_variant_get(v, "$.senses[0].glosses[0]", "variant")), F.lit(""))


def is_reconstructed(v: str) -> Column:
    senses = field(v, "senses", "array<struct<tags:array<variant>>>")
    return F.coalesce(F.exists(senses, lambda s: F.coalesce(F.exists(_strings(s["tags"]), lambda t: t == "reconstruction"), F.lit(False))), F.lit(False))


def entries(parsed: DataFrame, langs: Langs) -> DataFrame:
    """One row for each admissible record: its language known, and page term, term, part of speech and gloss all there."""
    rows = parsed.where("not is_redirect").select(
        "line_no",
        strict_string(field("v", "lang_code")).alias("code"),
        page_term("v").alias("page_term"),
        canonical_term("v").alias("term"),
        known_pos(valid(strict_string(field("v", "pos")))).alias("pos"),
        first_gloss("v").alias("gloss"),
        F.coalesce(strict_byte(field("v", "etymology_number")), F.lit(1)).alias("ety_num"),
        romanization("v").alias("romanization"),
        is_reconstructed("v").alias("is_reconstructed"),
        "v",
    )
    return admissible(rows).join(F.broadcast(langs.codes), "code").drop("code")


def admissible(rows: DataFrame) -> DataFrame:
    """The entries that have a page, a term, a part of speech and a gloss."""
    return rows.dropna(subset=["page_term", "term", "pos", "gloss"])


def ignored(title: str) -> Column:
    """Whether a title is in a namespace that is no dictionary."""
    return F.col(title).contains(":") & F.substring_index(title, ":", 1).isin(*NAMESPACES)


_ITEM = "struct<ety_num:int,line_no:bigint,lines:array<bigint>,pos:array<string>,gloss:array<string>,page_term:string,romanization:string,is_reconstructed:boolean>"


def merge_entries(rows: DataFrame) -> DataFrame:
    """Items from entries, by language and term, in the order of lines.

    An entry joins the last item with its etymology number, unless it is a root
    and that item has a root already; otherwise it is a new item: the first of
    its term keeps its number, later ones take the greatest so far plus 1.
    """
    entry = F.struct("line_no", "ety_num", "pos", "gloss", F.nullif("page_term", "term").alias("page_term"), "romanization", "is_reconstructed")
    grouped = rows.groupBy("lang_id", "term").agg(F.sort_array(F.collect_list(entry)).alias("entries"))

    def new(e: Column, number: Column) -> Column:
        return F.struct(number.cast("int").alias("ety_num"), e["line_no"].alias("line_no"), F.array(e["line_no"]).alias("lines"), F.array(e["pos"]).alias("pos"), F.array(e["gloss"]).alias("gloss"), e["page_term"].alias("page_term"), e["romanization"].alias("romanization"), e["is_reconstructed"].alias("is_reconstructed")).cast(_ITEM)

    def add(items: Column, e: Column) -> Column:
        same = F.transform(items, lambda i: i["ety_num"] == e["ety_num"])
        last = F.size(items) - F.array_position(F.reverse(same), F.lit(True)).cast("int")  # its index, if there is one
        blocked = (e["pos"] == "root") & F.array_contains(F.get(items, last)["pos"], "root")
        joins = F.array_contains(same, True) & ~F.coalesce(blocked, F.lit(False))
        grown = F.transform(
            items,
            lambda i, k: F.when(
                k == last,
                F.struct(i["ety_num"].alias("ety_num"), i["line_no"].alias("line_no"), F.array_append(i["lines"], e["line_no"]).alias("lines"), F.array_append(i["pos"], e["pos"]).alias("pos"), F.array_append(i["gloss"], e["gloss"]).alias("gloss"), i["page_term"].alias("page_term"), i["romanization"].alias("romanization"), i["is_reconstructed"].alias("is_reconstructed")).cast(_ITEM),
            ).otherwise(i),
        )
        number = F.when(F.size(items) == 0, e["ety_num"]).otherwise(F.array_max(F.transform(items, lambda i: i["ety_num"])) + 1)
        return F.when(joins, grown).otherwise(F.array_append(items, new(e, number)))

    items = grouped.select("lang_id", "term", F.explode(F.aggregate("entries", F.array().cast(f"array<{_ITEM}>"), add)).alias("i"))
    return items.select("lang_id", "term", "i.*")


def number_items(items: DataFrame) -> DataFrame:
    """items with item_id, gapless in the order of their first lines."""
    return dense_ids(materialize(items), "item_id", ["line_no"], F.floor(F.col("line_no") / 1_000_000))


def read_redirects(parsed: DataFrame, langs: Langs) -> tuple[DataFrame, DataFrame]:
    """Redirects between reconstructions (lang_id, term -> to_lang_id, to_term), and between plain terms (term -> to_term); the last line wins.

    A title in an ignored namespace drops the record, and so does a
    reconstruction of a known language that leads elsewhere.
    """
    rows = parsed.where("is_redirect").select("line_no", valid(strict_string(field("v", "title"))).alias("title"), valid(strict_string(field("v", "redirect"))).alias("target")).dropna()
    for c in ("title", "target"):
        rows = rows.where(~ignored(c))
    for c in ("title", "target"):
        names = F.broadcast(langs.names.select(F.col("name").alias(f"{c}_name"), F.col("lang_id").alias(f"{c}_lang")))
        rows = rows.withColumn(f"{c}_r", reconstruction_title(F.col(c))).join(names, F.col(f"{c}_r.lang_name") == F.col(f"{c}_name"), "left")
    recon = rows.where("title_lang is not null and target_lang is not null").groupBy(F.col("title_lang").alias("lang_id"), F.col("title_r.term").alias("term")).agg(F.max_by(F.struct("target_lang", "target_r.term"), "line_no").alias("to"))
    plain = rows.where("title_lang is null").groupBy(F.col("title").alias("term")).agg(F.max_by("target", "line_no").alias("to_term"))
    return recon.select("lang_id", "term", F.col("to.target_lang").alias("to_lang_id"), F.col("to.term").alias("to_term")), plain


def resolve_redirects(terms: DataFrame, langs: Langs, recon: DataFrame, plain: DataFrame) -> DataFrame:
    """terms (lang_id, term, ...) with key_lang and key_term: the language that has entries, then one redirect, a reconstruction's before a plain one."""
    real = F.broadcast(langs.langs.select(F.col("lang_id"), F.col("non_ety_id").alias("_lang")))
    r = recon.select(F.col("lang_id").alias("_lang"), F.col("term").alias("term"), F.col("to_lang_id").alias("_r_lang"), F.col("to_term").alias("_r_term"))
    p = plain.select("term", F.col("to_term").alias("_p_term"))
    joined = terms.join(real, "lang_id", "left").join(r, ["_lang", "term"], "left").join(p, "term", "left")
    return joined.withColumn("key_lang", F.coalesce("_r_lang", "_lang")).withColumn("key_term", F.coalesce("_r_term", "_p_term", "term")).drop("_lang", "_r_lang", "_r_term", "_p_term")
