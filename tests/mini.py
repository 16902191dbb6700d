"""A small dump and its languages."""

import json

LANGUAGES = {
    "en": {"mainCode": "en", "canonicalName": "English", "kind": "regular", "nonEtymologyOnly": "en", "ancestors": ["ine-pro", "gem-pro", "gmw-pro", "ang", "enm"]},
    "eng": {"mainCode": "en", "canonicalName": "English", "kind": "regular", "nonEtymologyOnly": "en", "ancestors": []},
    "enm": {"mainCode": "enm", "canonicalName": "Middle English", "kind": "regular", "nonEtymologyOnly": "enm", "ancestors": ["ine-pro", "gem-pro", "gmw-pro", "ang"]},
    "ang": {"mainCode": "ang", "canonicalName": "Old English", "kind": "regular", "nonEtymologyOnly": "ang", "ancestors": ["ine-pro", "gem-pro", "gmw-pro"]},
    "gmw-pro": {"mainCode": "gmw-pro", "canonicalName": "Proto-West Germanic", "kind": "reconstructed", "nonEtymologyOnly": "gmw-pro", "ancestors": ["ine-pro", "gem-pro"]},
    "gem-pro": {"mainCode": "gem-pro", "canonicalName": "Proto-Germanic", "kind": "reconstructed", "nonEtymologyOnly": "gem-pro", "ancestors": ["ine-pro"]},
    "ine-pro": {"mainCode": "ine-pro", "canonicalName": "Proto-Indo-European", "kind": "reconstructed", "nonEtymologyOnly": "ine-pro", "ancestors": []},
    "la": {"mainCode": "la", "canonicalName": "Latin", "kind": "regular", "nonEtymologyOnly": "la", "ancestors": ["ine-pro"]},
    "la-vul": {"mainCode": "la-vul", "canonicalName": "Vulgar Latin", "kind": "etymology-only", "nonEtymologyOnly": "la", "ancestors": ["ine-pro", "la"]},
    "non": {"mainCode": "non", "canonicalName": "Old Norse", "kind": "regular", "nonEtymologyOnly": "non", "ancestors": ["ine-pro", "gem-pro"]},
    "fro": {"mainCode": "fro", "canonicalName": "Old French", "kind": "regular", "nonEtymologyOnly": "fro", "ancestors": ["ine-pro", "la"]},
    "fi": {"mainCode": "fi", "canonicalName": "Finnish", "kind": "regular", "nonEtymologyOnly": "fi", "ancestors": []},
}


def word(code, term, gloss, pos="noun", **more):
    return {"word": term, "lang_code": code, "pos": pos, "senses": [{"glosses": [gloss]}]} | more


def template(name, *args, **named):
    return {"name": name, "args": {str(k + 1): a for k, a in enumerate(args)} | named}


RECORDS = [
    word("en", "father", "male parent", etymology_templates=[template("inh", "en", "enm", "fader"), template("inh", "en", "ang", "fæder")], etymology_text="From Middle English fader."),
    word("enm", "fader", "male parent", etymology_templates=[template("inh", "enm", "ang", "fæder")]),
    word("ang", "fæder", "male parent", etymology_templates=[template("inh", "ang", "gmw-pro", "*fader")]),
    word("gem-pro", "fadēr", "father", forms=[{"form": "*fadēr", "tags": ["canonical"]}], senses=[{"glosses": ["father"], "tags": ["reconstruction"]}], descendants=[
        {"depth": 1, "text": "x", "templates": [template("desc", "gmw-pro", "*fader")]},
        {"depth": 2, "text": "x", "templates": [template("desc", "ang", "fæder")]},
        {"depth": 1, "text": "x", "templates": [template("desc", "non", "faðir")]},
    ]),
    word("non", "faðir", "father"),
    word("ine-pro", "ph₂tḗr", "father", senses=[{"glosses": ["father"], "tags": ["reconstruction"]}], descendants=[
        {"depth": 1, "text": "x", "templates": [template("desc", "gem-pro", "*fadēr")]},
        {"depth": 1, "text": "x", "templates": [template("desc", "la", "pater", bor="1")]},
    ]),
    word("la", "pater", "father"),
    word("en", "fatherland", "native country", etymology_templates=[template("com", "en", "father", "land")]),
    word("en", "land", "ground", etymology_number=1, pos="noun"),
    word("en", "land", "to come down", etymology_number=1, pos="verb"),
    word("en", "land", "a lant", etymology_number=2),
    word("en", "paternal", "of a father", pos="adj", etymology_templates=[template("af", "en", "pater", "-al", lang2="la")]),
    word("en", "-al", "adjective ending", pos="suffix"),
    word("en", "redo", "do again", pos="verb", etymology_templates=[template("prefix", "en", "re", "do")]),
    word("en", "re-", "again", pos="prefix"),
    word("en", "do", "act", pos="verb", etymology_templates=[template("root", "en", "ine-pro", "*dʰeh₁- (put)")]),
    word("ine-pro", "dʰeh₁-", "to put", pos="root"),
    word("ine-pro", "dʰeh₁-", "to suck", pos="root"),
    word("en", "happenin'", "happening", senses=[{"glosses": ["happening"], "alt_of": [{"word": "happening"}]}]),
    word("en", "happening", "event"),
    word("en", "a,b", "dropped for its comma"),
    word("en", "set phrase", "dropped for its part of speech", pos="phrase"),
    word("xx", "nothing", "dropped for its language"),
    word("en", "number", "numeric argument", etymology_templates=[{"name": "inh", "args": {"1": "en", "2": "enm", "3": 5}}]),
    word("en", "romanic", "of Rome", pos="adj", etymology_templates=[template("der", "en", "la-vul,la", "romanicus")]),
    word("la", "romanicus", "of Rome", pos="adj", forms=[{"form": "rōmānicus", "tags": ["canonical"]}, {"form": "rr", "tags": ["romanization"]}]),
    word("en", "loop", "a ring", etymology_templates=[template("der", "en", "fi", "luuppi")]),
    word("fi", "luuppi", "a loop", etymology_templates=[template("der", "fi", "en", "loop")]),
    word("en", "colour", "hue", etymology_templates=[template("der", "en", "fro", "colur")]),
    word("fro", "color", "hue"),
    {"title": "colur", "redirect": "color"},
    {"title": "Template:x", "redirect": "y"},
    {"title": "Reconstruction:Proto-Germanic/old", "redirect": "Reconstruction:Proto-Germanic/fadēr"},
]


def write(path):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in RECORDS), encoding="utf-8")
    return str(path)
