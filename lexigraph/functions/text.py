"""Text as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT_CATEGORY = r"^(.+) terms derived from the (.+) root \*([^ ]+)(?: \((.+)\))?$"
RECONSTRUCTION = r"(?s)^Reconstruction:([^/]*)/(.*)$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value evaluated once; within lambdas Spark evaluates an expression anew wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def valid(c: Column) -> Column:
    """A string that is neither empty nor a lone hyphen, else null."""
    return F.nullif(F.nullif(c, F.lit("")), F.lit("-"))


def clean_term(c: Column) -> Column:
    """One leading asterisk off, then what follows a '#', then what follows ' ('."""
    return F.substring_index(F.substring_index(F.regexp_replace(c, r"^\*", ""), "#", 1), " (", 1)


def valid_term(c: Column) -> Column:
    return let(c, lambda x: let(clean_term(valid(x)), valid))


def affix_term(c: Column, kind: str) -> Column:
    """The valid term with the hyphens that its kind of affix needs: prefix, suffix, infix or base."""
    front = lambda t: F.when(t.startswith("-"), t).otherwise(F.concat(F.lit("-"), t))
    back = lambda t: F.when(t.endswith("-"), t).otherwise(F.concat(t, F.lit("-")))
    t = valid_term(c)
    if kind in ("suffix", "infix"):
        t = let(t, front)
    return let(t, back) if kind in ("prefix", "infix") else t


def affix_class(term: Column) -> Column:
    """How a written term stands in a compound: infix, suffix, prefix or base."""
    return F.when(term.startswith("-") & term.endswith("-"), "infix").when(term.startswith("-"), "suffix").when(term.endswith("-"), "prefix").otherwise("base")


def affix_mode(classes: Column) -> Column:
    """The narrowest mode for an affix template whose terms are of these classes."""
    n = F.size(classes)
    two = lambda a, b: (n == 2) & (F.get(classes, 0) == a) & (F.get(classes, 1) == b)
    infix = (n == 3) & (F.get(classes, 0) == "base") & (F.get(classes, 1) == "infix") & (F.get(classes, 2) == "base")
    return F.when(F.forall(classes, lambda x: x == "base"), "compound").when(infix, "infix").when(two("prefix", "suffix"), "confix").when(two("prefix", "base"), "prefix").when(two("base", "suffix"), "suffix").otherwise("affix")


def first_of_list(c: Column) -> Column:
    """What stands before the first comma."""
    return F.substring_index(c, ",", 1)


def normalize_name(c: Column) -> Column:
    """A language name for search: no parentheses, spaces for hyphens, ASCII letters in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper + "-()", upper.lower() + " ")


def percent_encode(c: Column) -> Column:
    """RFC 3986: unreserved characters stay, a space is %20."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def reconstruction_title(c: Column) -> Column:
    """struct(lang_name, term) of a title in the reconstruction namespace, else null."""
    hit = c.rlike(RECONSTRUCTION)
    return F.when(hit, F.struct(F.regexp_extract(c, RECONSTRUCTION, 1).alias("lang_name"), F.regexp_extract(c, RECONSTRUCTION, 2).alias("term")))


def root_category(c: Column) -> Column:
    """struct(term_lang, root_lang, term, sense) of a category that names a root, else null."""
    part = lambda k: F.regexp_extract(c, ROOT_CATEGORY, k)
    return F.when(c.rlike(ROOT_CATEGORY), F.struct(part(1).alias("term_lang"), part(2).alias("root_lang"), part(3).alias("term"), F.nullif(part(4), F.lit("")).alias("sense")))


def sense_id(term: Column, fallback: Column) -> Column:
    """What stands between the last ' (' and the last ')' of a term; without both, the fallback."""
    inner = F.regexp_extract(term, r"(?s)^.* \(((?:(?! \().)*)\)[^)]*$", 1)
    return F.nullif(F.when(term.contains(" (") & term.contains(")"), inner).otherwise(valid(fallback)), F.lit(""))


def search_term(c: Column) -> Column:
    """A typed term for search: trimmed, one leading asterisk off, in lower case."""
    return F.lower(F.regexp_replace(F.trim(c), r"^\*", ""))


def display_term(term: Column, reconstructed: Column) -> Column:
    return F.when(reconstructed, F.concat(F.lit("*"), term)).otherwise(term)


def turtle_string(c: Column) -> Column:
    """A quoted Turtle literal."""
    for raw, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))


def item_url(reconstructed: Column, term: Column, page_term: Column, lang_name: Column, site: str = "https://en.wiktionary.org/wiki/") -> Column:
    """The page of a real item: its own namespace if reconstructed, otherwise the language's section of its page."""
    title, lang = percent_encode(F.coalesce(page_term, term)), percent_encode(F.replace(lang_name, F.lit(" "), F.lit("_")))
    return F.when(reconstructed, F.concat(F.lit(site + "Reconstruction:"), lang, F.lit("/"), title)).otherwise(F.concat(F.lit(site), title, F.lit("#"), lang))
