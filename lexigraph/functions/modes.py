"""Etymological modes, parts of speech and what the displays call them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of each kind the modes, and behind each its aliases in templates.
KINDS = {
    "derived": "derived:der,der-lite|inherited:inh,inh-lite|borrowed:bor|learned borrowing:lbor|semi-learned borrowing:slbor,slb|unadapted borrowing:ubor|orthographic borrowing:obor|semantic loan:sl,sml|calque:cal,clq|partial calque:pcal,pclq|phono-semantic matching:psm|undefined derivation:uder,der?|transliteration:translit",
    "abbreviation": "abbreviation:abbrev|adverbial accusative|contraction:contr|reduplication:rdp|syncopic form:sync|rebracketing|nominalization:nom|ellipsis|acronym|initialism|conversion|clipping|causative|back-formation:back-form,bf|deverbal|apocopic form|aphetic form",
    "compound": "compound:com|univerbation:univ|transfix|surface analysis:surf|suffix:suf|prefix:pre|infix|confix:con|circumfix|blend|affix:af",
    "vrddhi": "vṛddhi:vrddhi,vrd|vṛddhi-ya:vrddhi-ya,vrd-ya",
    "special": "root|form|morphological derivation|mention:m",
}
MODES: dict[str, str] = {}
ALIASES: dict[str, str] = {}
for _kind, _text in KINDS.items():
    for _entry in _text.split("|"):
        _name, _, _others = _entry.partition(":")
        MODES[_name] = _kind
        ALIASES |= dict.fromkeys([_name, *filter(None, _others.split(","))], _name)

POS = frozenset(
    "abbrev adj adj_noun adj_verb adv adv_phrase affix ambiposition article character circumfix circumpos classifier clause combining_form "
    "conj contraction converb counter det infix interfix intj name noun num particle phrase postp prefix prep prep_phrase preverb pron "
    "proverb punct romanization root suffix syllable symbol verb".split()
)
#: Keys of a descendant template that tell its mode, the first that is there counts.
DESCENDANT_KEYS = ("bor", "lbor", "slb", "clq", "pclq", "sml", "translit")

_NOUNS = {"undefined derivation": "derived", "mention": "derived", "morphological derivation": "derivation"} | {x: x + "ation" for x in ("transfix", "suffix", "prefix", "infix", "confix", "circumfix", "affix")}
_PREPOSITIONS = dict.fromkeys(("derived", "inherited", "borrowed", "back-formation", "undefined derivation", "mention"), " from ") | {"surface analysis": ": ", "root": " reflex of "} | dict.fromkeys(("vṛddhi", "vṛddhi-ya"), " derivative of ")
_COLOURS = "2F2E7A 0B3577 143867 0D3D4D 06412C 004300 224000 493500 672001 740A16 740549 730138".split()


def _map(pairs: dict[str, str]) -> Column:
    """A constant map, parsed at once: as literals it would be hundreds of calls to the JVM."""
    return F.expr("map(" + ", ".join(f"'{x}'" for x in chain.from_iterable(pairs.items())) + ")")


def mode_of(name: Column) -> Column:
    """The mode that a template's name stands for, else null."""
    return F.try_element_at(_map(ALIASES), name)


def kind_of(mode: Column) -> Column:
    return F.try_element_at(_map(MODES), mode)


def known_pos(c: Column) -> Column:
    """A part of speech that is known and not a phrase, else null."""
    return F.when(~c.contains("phrase") & c.isin(*sorted(POS)), c)


def mode_noun(mode: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(_NOUNS), mode), mode)


def mode_preposition(mode: Column) -> Column:
    return F.when(mode.isNotNull(), F.coalesce(F.try_element_at(_map(_PREPOSITIONS), mode), F.lit(" of ")))


def distance_colour(distance: Column) -> Column:
    """A colour for a language distance; grey for unrelated ones, and null just past the palette, where no colour is defined."""
    palette = F.array(*[F.lit("#" + x) for x in _COLOURS])
    n = len(_COLOURS)
    return F.when(distance.isNull(), "#696969").when(distance > n, F.lit("#" + _COLOURS[-1])).otherwise(F.get(palette, F.greatest(distance, F.lit(0))))
