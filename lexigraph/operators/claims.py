"""Claims of ancestry, parsed from templates with Column expressions.

A claim is a mode, the place of its head term, and terms of some languages.
Whether a language code is known is a broadcast join on the exploded terms; one
shuffle by line puts the claims together again.  What an expression mentions
more than once is bound with `let`, or stands in a projection of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.functions.modes import ALIASES, DESCENDANT_KEYS, kind_of, mode_of
from lexigraph.functions.text import affix_class, affix_mode, affix_term, first_of_list, let, root_category, sense_id, valid, valid_term
from lexigraph.sources.dump import field, strict_byte, strict_string
from lexigraph.sources.langs import Langs, with_lang

_TEMPLATES = "array<struct<name:variant,args:map<string,variant>>>"
_TERMS = "array<struct<code:string,term:string>>"
_PARSED = f"struct<mode:string,head:int,terms:{_TERMS}>"


def templates(v: str | Column) -> Column:
    """The etymology templates of a record as structs (name, args); an argument that isn't a string is null."""
    return _plain(field(v, "etymology_templates", _TEMPLATES))


def _plain(raw: Column) -> Column:
    return F.transform(raw, lambda t: F.struct(let(strict_string(t["name"]), valid).alias("name"), F.transform_values(t["args"], lambda _, x: strict_string(x)).alias("args")))


def arg(args: Column, key: str | Column) -> Column:
    return let(F.try_element_at(args, F.lit(key) if isinstance(key, str) else key), valid)


def term(args: Column, key: str | Column) -> Column:
    return valid_term(F.try_element_at(args, F.lit(key) if isinstance(key, str) else key))


def _affix(args: Column, key: str, kind: str) -> Column:
    return affix_term(F.try_element_at(args, F.lit(key)), kind)


def claim(mode: Column | str, head: Column | int | None, *terms: tuple[Column, Column]) -> Column:
    """A claim if each of its terms has a code and a text, else null."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    head = head if isinstance(head, Column) else F.lit(head)
    parts = F.array(*[F.struct(c.alias("code"), t.alias("term")) for c, t in terms]).cast(_TERMS)
    there = lambda p: F.forall(p, lambda x: x["code"].isNotNull() & x["term"].isNotNull())
    return let(parts, lambda p: F.when(there(p), F.struct(mode.alias("mode"), head.cast("int").alias("head"), p.alias("terms")).cast(_PARSED)))


def leading(values: Column) -> Column:
    """The elements before the first null."""
    gap = lambda x: F.array_position(F.transform(x, lambda y: y.isNull()), F.lit(True)).cast("int")
    return let(values, lambda x: let(gap(x), lambda g: F.when(g == 0, x).otherwise(F.slice(x, 1, F.greatest(g - 1, F.lit(0))))))


def compound(mode: Column, args: Column, code: Column) -> Column:
    """A compound's terms, arguments 2, 3 and so on up to the first invalid one; its head is the only term that isn't an affix."""
    numbers = F.sequence(F.lit(2), F.size(F.map_keys(args)) + 2)
    parts = lambda found: F.transform(found, lambda t, k: F.struct(F.coalesce(arg(args, F.concat(F.lit("lang"), (k + 2).cast("string"))), code).alias("code"), t.alias("term"))).cast(_TERMS)
    head = lambda base: F.when(F.size(F.filter(base, lambda x: x)) == 1, F.array_position(base, F.lit(True)).cast("int") - 1)
    refined = lambda classes: F.when(mode == "affix", affix_mode(classes)).otherwise(mode)
    whole = lambda found: let(F.transform(found, affix_class), lambda classes: F.struct(refined(classes).alias("mode"), let(F.transform(classes, lambda c: c == "base"), head).alias("head"), parts(found).alias("terms")).cast(_PARSED))
    return let(leading(F.transform(numbers, lambda n: term(args, n.cast("string")))), lambda found: F.when(F.size(found) > 0, whole(found)))


def etymology_claim(name: Column, args: Column, code: Column) -> Column:
    """What one etymology template of an item in the language `code` claims; null if it isn't understood."""
    return let(mode_of(name), lambda mode: let(kind_of(mode), lambda kind: _claim_of(mode, kind, args, code)))


def _claim_of(mode: Column, kind: Column, args: Column, code: Column) -> Column:
    prefix, suffix = _affix(args, "2", "prefix"), _affix(args, "4", "suffix")
    confix = let(
        suffix,
        lambda last: F.when(last.isNotNull(), claim("confix", 1, (code, prefix), (code, term(args, "3")), (code, last))).otherwise(
            claim("confix", None, (code, prefix), (code, F.concat(F.lit("-"), term(args, "3"))))
        ),
    )
    own = (
        F.when(kind == "derived", claim(mode, 0, (first_of_list(arg(args, "2")), term(args, "3"))))
        .when(kind == "abbreviation", claim(mode, 0, (code, term(args, "2"))))
        .when(mode == "prefix", claim("prefix", 1, (code, prefix), (code, term(args, "3"))))
        .when(mode == "suffix", claim("suffix", 0, (code, term(args, "2")), (code, _affix(args, "3", "suffix"))))
        .when(mode == "circumfix", claim("circumfix", 0, (code, term(args, "3")), (code, F.concat(prefix, F.lit(" "), suffix))))
        .when(mode == "infix", claim("infix", 0, (code, term(args, "2")), (code, _affix(args, "3", "infix"))))
        .when(mode == "confix", confix)
        .when(kind == "compound", compound(mode, args, code))
    )
    return F.when(kind == "vrddhi", claim(mode, 0, (arg(args, "1"), term(args, "2")))).when(arg(args, "1") == code, own)


def single_mention(found: Column) -> Column:
    """The claim of a record whose only template, roots aside, is a mention."""
    read = lambda only: F.when(only["name"].isin("mention", "m"), claim("mention", 0, (arg(only["args"], "1"), term(only["args"], "2"))))
    return let(F.filter(found, lambda t: F.coalesce(t["name"] != "root", F.lit(False))), lambda others: F.when(F.size(others) == 1, let(F.get(others, 0), read)))


def form_claim(v: str | Column, code: Column) -> Column:
    """The term that the first sense says it is an alternative (else a form) of, as it is written there."""
    word = lambda key: F.get(F.try_variant_get(v, f"$.senses[0].{key}", "array<struct<word:variant>>"), 0)["word"]
    listed = F.try_variant_get(v, "$.senses[0].alt_of", "array<variant>").isNotNull()
    return claim("form", 0, (code, strict_string(F.when(listed, word("alt_of")).otherwise(word("form_of")))))


def etymologies(items: DataFrame, langs: Langs) -> DataFrame:
    """(item_id, claims) from items (item_id, code, v): claims in order, each (ok, mode, head, terms of (lang_id, term)).

    A single mention comes first, then all templates (those not understood are
    not ok), and only without any template the form that the first sense names.
    """
    base = items.select("item_id", "code", templates("v").alias("found"), form_claim("v", F.col("code")).alias("form"))
    base = base.select("item_id", "code", "found", single_mention(F.col("found")).alias("mention"), "form")
    known = F.broadcast(langs.codes.select(F.col("code").alias("_code")))
    # a mention of an unknown language doesn't count
    base = base.join(known, F.get("mention.terms", 0)["code"] == F.col("_code"), "left")
    standard = F.when(F.size("found") > 0, F.transform("found", lambda t: etymology_claim(t["name"], t["args"], F.col("code"))))
    chosen = F.when(F.col("_code").isNotNull(), F.array("mention")).otherwise(F.coalesce(standard, F.when(F.col("form").isNotNull(), F.array("form"))))
    rows = base.select("item_id", F.posexplode(chosen).alias("nth", "c"))
    terms = with_lang(rows.select("item_id", "nth", "c.mode", "c.head", F.posexplode_outer("c.terms").alias("ord", "t")).withColumn("code", F.col("t.code")), langs, "code", "")
    part = F.struct("ord", "lang_id", F.col("t.term").alias("term"))
    each = terms.repartition("item_id").groupBy("item_id", "nth").agg(F.first("mode").alias("mode"), F.first("head").alias("head"), (F.min(F.col("lang_id").isNotNull())).alias("ok"), F.sort_array(F.collect_list(part)).alias("terms"))
    one = F.struct("nth", "ok", F.when(F.col("ok"), F.col("mode")).alias("mode"), F.when(F.col("ok"), F.col("head")).alias("head"), F.when(F.col("ok"), F.transform("terms", lambda x: F.struct(x["lang_id"].alias("lang_id"), x["term"].alias("term")))).alias("terms"))
    return each.groupBy("item_id").agg(F.sort_array(F.collect_list(one)).alias("claims"))


def descendant_mode(args: Column, n: Column) -> Column:
    """The mode of the n-th term of a descendant template: by the first mode key it has, whatever the value."""
    mode, number = F.lit("inherited"), n.cast("string")
    for key in reversed(DESCENDANT_KEYS):
        there = F.coalesce(F.map_contains_key(args, key) | F.map_contains_key(args, F.concat(F.lit(key), number)), F.lit(False))
        mode = F.when(there, F.lit(ALIASES[key])).otherwise(mode)
    return mode


def descendant_template(name: Column, args: Column, derived: Column) -> Column:
    """struct(code, terms of (term, mode)) of a template in a descendants line, else null."""
    shape = "struct<code:string,terms:array<struct<term:string,mode:string>>>"
    numbers = F.sequence(F.lit(1), F.size(F.map_keys(args)) + 1)
    named = lambda n: F.coalesce(term(args, (n + 1).cast("string")), term(args, F.when(n == 1, "alt").otherwise(F.concat(F.lit("alt"), n.cast("string")))))
    many = F.transform(leading(F.transform(numbers, named)), lambda t, k: F.struct(t.alias("term"), descendant_mode(args, k + 1).alias("mode")))
    one = lambda value, mode: let(value, lambda t: F.when(t.isNotNull(), F.array(F.struct(t.alias("term"), mode.alias("mode")))))
    link = one(F.coalesce(term(args, "2"), term(args, "3")), F.when(derived, "morphological derivation").otherwise("derived"))
    tree = one(term(args, "2"), descendant_mode(args, F.lit(1)))
    terms = F.when(name.isin("desc", "descendant"), many).when(name.isin("l", "link"), link).when(name.isin("desctree", "descendants tree"), tree)
    whole = F.struct(arg(args, "1").alias("code"), terms.alias("terms")).cast(shape)
    return let(whole, lambda x: F.when(x["code"].isNotNull() & x["terms"].isNotNull(), x))


def descendant_lines(v: str | Column) -> Column:
    """The lines of a record's descendants as structs (depth, text, derived, templates); null if any line lacks its depth or templates."""
    raw = field(v, "descendants", f"array<struct<depth:variant,text:variant,tags:array<variant>,templates:{_TEMPLATES}>>")
    lines = F.transform(
        raw,
        lambda x: F.struct(
            strict_byte(x["depth"]).alias("depth"),
            let(strict_string(x["text"]), valid).alias("text"),
            F.coalesce(F.exists(x["tags"], lambda t: F.coalesce(strict_string(t) == "derived", F.lit(False))), F.lit(False)).alias("derived"),
            _plain(x["templates"]).alias("templates"),
        ),
    )
    whole = lambda y: F.forall(y, lambda x: x["depth"].isNotNull() & x["templates"].isNotNull()) & (F.size(y) > 0)
    return let(lines, lambda y: F.when(whole(y), y))


def descendants(items: DataFrame, langs: Langs) -> DataFrame:
    """(item_id, lines) from rows (item_id, line_no, v), several for an item whose entries were merged: lines in order.

    Each line has depth, kind (text, lang, desc or other), and if it is a desc
    lang_id and terms of (term, mode): its templates name one known language and
    at least one term.
    """
    rows = items.select("item_id", "line_no", F.posexplode(descendant_lines("v")).alias("nth", "x"))
    parsed = F.transform("x.templates", lambda t: descendant_template(t["name"], t["args"], F.col("x.derived")))
    alone = F.get("x.templates", 0)
    lone = F.when((F.size("x.templates") == 1) & alone["name"].isin("desc", "descendant") & term(alone["args"], "2").isNull() & term(alone["args"], "alt").isNull(), arg(alone["args"], "1"))
    rows = rows.select("item_id", "line_no", "nth", "x.depth", ((F.size("x.templates") == 0) & F.col("x.text").isNotNull()).alias("is_text"), lone.alias("lone"), F.posexplode_outer(parsed).alias("k", "p")).withColumn("code", F.col("p.code"))
    rows = with_lang(with_lang(rows, langs, "code", ""), langs, "lone", "lone_")
    got = F.when(F.col("lang_id").isNotNull(), F.struct("k", F.col("p.terms").alias("terms")))
    each = (
        rows.repartition("item_id")
        .groupBy("item_id", "line_no", "nth")
        .agg(F.first("depth").alias("depth"), F.first("is_text").alias("is_text"), F.first("lone_lang_id").alias("lone"), F.collect_set("lang_id").alias("langs"), F.sort_array(F.collect_list(got)).alias("got"))
        .withColumn("terms", F.flatten(F.transform("got", lambda x: x["terms"])))
    )
    kind = F.when(F.col("is_text"), "text").when(F.col("lone").isNotNull(), "lang").when((F.size("langs") == 1) & (F.size("terms") > 0), "desc").otherwise("other")
    each = each.withColumn("kind", kind)
    desc = F.col("kind") == "desc"
    line = F.struct("line_no", "nth", "depth", "kind", F.when(desc, F.get("langs", 0)).when(F.col("kind") == "lang", F.col("lone")).alias("lang_id"), F.when(desc, F.col("terms")).alias("terms"))
    return each.groupBy("item_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))


def roots(items: DataFrame, langs: Langs) -> DataFrame:
    """(item_id, lang_id, term, sense) from items (item_id, code, lang_id, v): the root an item comes from.

    The first root template decides, even if it can't be read; only without one
    does the first category that names a root of the item's language.
    """
    first_root = F.get(F.filter(templates("v"), lambda t: F.coalesce(t["name"].isin("root", "word", "PIE word"), F.lit(False)) & t["args"].isNotNull()), 0)
    # behind a generator, through which no filter is pushed: it would parse the record again for each mention
    once = F.explode(F.array(F.struct(first_root.alias("found"), field("v", "categories", "array<variant>").alias("categories")))).alias("x")
    items = items.select("item_id", "code", "lang_id", once).select("item_id", "code", "lang_id", "x.*")
    found = F.col("found")
    args, name = found["args"], found["name"]
    own = arg(args, "1") == F.col("code")
    usual = F.when(own & term(args, "4").isNull() & term(args, "3").isNotNull(), F.struct(F.when(name == "word", F.concat(arg(args, "2"), F.lit("-pro"))).otherwise(arg(args, "2")).alias("code"), term(args, "3").alias("term"), sense_id(arg(args, "3"), F.try_element_at(args, F.lit("id"))).alias("sense")))
    word = F.when(own & term(args, "2").isNotNull(), F.struct(F.lit("ine-pro").alias("code"), term(args, "2").alias("term"), F.lit(None).cast("string").alias("sense")))
    base = items.select("item_id", F.col("lang_id").alias("item_lang"), found.isNotNull().alias("decided"), F.when(name == "PIE word", word).otherwise(usual).alias("r"), "categories")
    templated = with_lang(base.where("decided and r is not null").select("item_id", "r.code", "r.term", "r.sense"), langs, "code", "").where("lang_id is not null").select("item_id", "lang_id", "term", "sense")
    named = base.where("not decided").select("item_id", "item_lang", F.posexplode(F.transform("categories", strict_string)).alias("nth", "c")).withColumn("r", root_category(F.col("c"))).where("r is not null")
    name_of = lambda prefix: F.broadcast(langs.names.select(F.col("name").alias(f"{prefix}_name"), F.col("lang_id").alias(f"{prefix}_id")))
    named = named.join(name_of("t"), F.col("r.term_lang") == F.col("t_name")).join(name_of("r"), F.col("r.root_lang") == F.col("r_name")).where("t_id = item_lang")
    first = F.row_number().over(Window.partitionBy("item_id").orderBy("nth"))
    from_categories = named.withColumn("_first", first).where("_first = 1").select("item_id", F.col("r_id").alias("lang_id"), "r.term", "r.sense")
    return templated.unionByName(from_categories)
