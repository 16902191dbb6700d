"""Texts and names for the tests of this folder."""

WORDS = [a + b for a in "thing reed hand stone light water green field north south".split() for b in ("", "s", "er", "ing", "ed", "ly")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


#: Columns that have the names the operators use inside.
EXTRA = ("id", "owner", "words", "ranked", "row_key", "bucket", "cut_id", "cut_text", "f1", "f2", "group_id", "v", "cell", "d", "row_id", "label", "part", "keys", "predicted", "count", "row")
