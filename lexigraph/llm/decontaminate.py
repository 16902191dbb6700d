"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: each segment (a slice of some megabytes of
text) holds the postings of its own words, so building it moves nothing between
machines, and the same stored index answers any number of test sets.  A posting
is a word's place in the segment; places of different documents are far apart,
so no phrase and no window spans two documents.

A test item is looked for in every segment:

- phrase: each run of `phrase` consecutive item words (or the whole item if it
  is shorter) is found by intersecting the offset-adjusted postings of its
  words, the rarest in the segment first; a run with an absent word ends there.
- proximity: a window of `slack` times the item's length that holds at least
  `share` of its distinct words.  At least some of the rarest words must be in
  it, which leaves few windows; those are checked against every word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.textops import U64, Lookup, Texts, longs, numbered, slices, with_ids, written

PHRASE, SHARE, SLACK, LEAST = 8, 0.8, 1.25, 8
GAP = 4096
SEGMENT_BYTES = 1 << 22
#: Test words that are sent to every index-building task at most; beyond it segments store the postings of all their words.
TERMS_LIMIT = 4_000_000


def item_words(texts: list[str]) -> list[np.ndarray]:
    """The word hashes of each text."""
    out = []
    for _, _, part in slices(pa.array(texts, pa.string())):
        words = part.words()
        out += np.split(words.hashes(), words.first[1:-1])
    return out


def _segment(ids: np.ndarray, texts: Texts, terms: Lookup | None, gap: int):
    """One index row: documents with their first places, and postings by word."""
    words = texts.words()
    hashes = words.hashes()
    count = np.diff(words.first)
    base = np.cumsum(count + gap) - count  # a gap before each document
    place = np.arange(len(words)) + np.repeat(base - words.first[:-1], count)
    if terms is not None:
        number = terms(hashes)
        known = number >= 0
        number, place = number[known], place[known]
        if len(terms.keys) < 1 << 16:
            number = number.astype(np.uint16)  # which sorts by radix
        order = np.argsort(number, kind="stable")
        number, place = number[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, dtype=np.int64)
        keys = terms.keys[number[first]]
    else:
        order = np.argsort(hashes, kind="stable")
        hashes, place = hashes[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, dtype=np.int64)
        keys = hashes[first]
    order = np.argsort(keys)
    sizes = np.diff(np.append(first, len(place)))
    rows = np.repeat(first[order], sizes[order]) + np.arange(len(place)) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order])
    return ids, base, keys[order], sizes[order], place[rows]


def build_index(docs: DataFrame, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """One row for each segment: (docs, bases, keys, sizes, postings), all binary arrays.

    terms, if given, are the only word hashes whose postings are stored.
    No window of more than half of gap places may be looked for.  Documents
    without an id are left out; null and empty texts have no postings.
    """
    lookup = docs.sparkSession.sparkContext.broadcast(Lookup(np.unique(terms))) if terms is not None else None

    def run(batches):
        known = lookup.value if lookup is not None else None
        for batch in batches:
            ids, there = longs(batch.column(0))
            for lo, hi, texts in slices(batch.column(1), SEGMENT_BYTES):
                doc, base, keys, sizes, places = _segment(ids[lo:hi], texts, known, gap)
                columns = (doc, base, keys, sizes.astype(np.uint32), places.astype(np.uint32) if len(texts) and (not len(places) or places.max() < 2**32) else places)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns] + [pa.array([places.dtype.itemsize if columns[4] is places else 4], pa.int32())], names=["docs", "bases", "keys", "sizes", "postings", "width"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(id_col).isNotNull()).mapInArrow(run, "docs binary, bases binary, keys binary, sizes binary, postings binary, width int")


class Items:
    """Test items prepared for search: phrase runs and distinct words as places in `terms`."""

    def __init__(self, ids: list[int], words: list[np.ndarray], phrase: int, share: float):
        self.terms = np.unique(np.concatenate([*words, np.zeros(0, dtype=U64)]))
        self.ids = np.array(ids, dtype=np.int64)
        self.words = [np.searchsorted(self.terms, w) for w in words]
        runs, owner, place, length = [], [], [], []
        for k, w in enumerate(self.words):
            if not len(w):
                continue
            n = min(phrase, len(w))
            view = np.lib.stride_tricks.sliding_window_view(w, n)
            runs.append(np.pad(view, ((0, 0), (0, phrase - n)), constant_values=-1))
            owner.append(np.full(len(view), k))
            place.append(np.arange(len(view)))
            length.append(np.full(len(view), n))
        distinct = [np.unique(w) for w in self.words]
        self.many = np.array([len(x) for x in distinct], dtype=np.int64)
        self.need = np.ceil(share * self.many).astype(np.int64)
        self.distinct = np.concatenate([*distinct, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        empty = np.zeros(0, dtype=np.int64)
        self.runs = np.concatenate(runs) if runs else np.zeros((0, phrase), dtype=np.int64)
        self.owner, self.place, self.length = (np.concatenate(x) if x else empty for x in (owner, place, length))


def _likely(items: Items, size: np.ndarray) -> np.ndarray:
    """The items enough of whose distinct words occur in the segment."""
    there = np.append(0, np.cumsum(size[items.distinct] > 0))
    ends = np.cumsum(items.many)
    return np.flatnonzero((items.many >= LEAST) & (there[ends] - there[ends - items.many] >= items.need))


def _phrases(items: Items, first: np.ndarray, size: np.ndarray, postings: np.ndarray):
    """(item, start, end) of each phrase run found, by place in the segment."""
    pad = items.runs < 0
    sizes = np.where(pad, np.iinfo(np.int64).max, size[items.runs])
    for r in np.flatnonzero(sizes.min(axis=1, initial=1) > 0):
        order = np.argsort(sizes[r], kind="stable")[: items.length[r]]
        rare = items.runs[r, order[0]]
        at = postings[first[rare] : first[rare] + size[rare]] - order[0]
        for k in order[1:]:
            term = items.runs[r, k]
            have = postings[first[term] : first[term] + size[term]]
            spot = np.searchsorted(have, at + k)
            at = at[(spot < len(have)) & (have[np.minimum(spot, len(have) - 1)] == at + k)]
            if not len(at):
                break
        if len(at):
            yield items.owner[r], at, at + items.length[r]


def _windows(words: np.ndarray, share: float, slack: float, first: np.ndarray, size: np.ndarray, postings: np.ndarray):
    """(start, end, distinct words) of windows that hold enough of the distinct words."""
    distinct = np.unique(words)
    need = math.ceil(share * len(distinct))
    width = math.ceil(slack * len(words))
    distinct = distinct[np.argsort(size[distinct], kind="stable")]
    if np.count_nonzero(size[distinct]) < need:
        return
    # of the rarer half, so many must be in the window even if all the others are
    rare = distinct[: max(len(distinct) - need + 1, len(distinct) // 2)]
    least = need - (len(distinct) - len(rare))
    spans = [postings[first[t] : first[t] + size[t]] for t in rare if size[t]]
    if len(spans) < least:
        return
    # every window of this width lies in a block of twice the width, of which one begins at each multiple of the width
    block = np.concatenate([np.unique(np.concatenate([p // width, np.maximum(p // width - 1, 0)])) for p in spans])
    blocks, hits = np.unique(block, return_counts=True)
    for b in blocks[hits >= least]:
        lo, hi = b * width, (b + 2) * width
        places, term = [], []
        for t in distinct:
            p = postings[first[t] : first[t] + size[t]]
            p = p[np.searchsorted(p, lo) : np.searchsorted(p, hi)]
            places.append(p)
            term.append(np.full(len(p), t))
        places, term = np.concatenate(places), np.concatenate(term)
        if len(np.unique(term)) < need:
            continue
        order = np.argsort(places)
        places, term = places[order], term[order]
        ends = np.searchsorted(places, places + width)
        best = max(range(len(places)), key=lambda i: (len(np.unique(term[i : ends[i]])), -i))
        found = len(np.unique(term[best : ends[best]]))
        if found >= need:
            yield int(places[best]), int(places[ends[best] - 1]) + 1, found


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    phrase: int = PHRASE,
    share: float = SHARE,
    slack: float = SLACK,
) -> DataFrame:
    """(doc_id, item_id, kind, n_words, coverage): each document that holds a phrase of a test item, or nearly all of its words close together.

    kind is 'phrase' with n_words the item words covered by phrase runs, or
    'proximity' (where no phrase is) with n_words the distinct words in the best
    window; coverage divides by the item's words, or its distinct words.  Words
    are runs of letters and digits, compared without regard to ASCII case.  An
    item shorter than `phrase` must occur whole, and one of fewer than LEAST
    distinct words counts only as a phrase.  Null or wordless items match
    nothing, as do null and empty texts and rows without an id.  Rows that
    repeat an id are each searched; the best match by id and item is returned.
    Ids of any orderable type will do.

    The items are read to the driver: a test set has a size of its own that
    doesn't grow with the corpus.  Its words prune the stored postings while
    there are at most TERMS_LIMIT of them.
    """
    docs, own_doc = numbered(docs.select(id_col, text_col), id_col)
    tests, own_item = numbered(benchmark.select(item_col, item_text_col).where(F.col(item_col).isNotNull()).distinct(), item_col)
    rows = tests.orderBy(item_col, item_text_col).collect()
    items = Items([r[0] for r in rows], item_words([r[1] or "" for r in rows]), phrase, share)
    index = written(build_index(docs, items.terms if len(items.terms) <= TERMS_LIMIT else None, id_col, text_col, max(GAP, 2 * math.ceil(slack * max(map(len, items.words), default=0)) + 1)))
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        items = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                doc, base = (np.frombuffer(batch.column(c)[r].as_py(), dtype=np.int64) for c in (0, 1))
                keys = np.frombuffer(batch.column(2)[r].as_py(), dtype=U64)
                sizes = np.frombuffer(batch.column(3)[r].as_py(), dtype=np.uint32).astype(np.int64)
                postings = np.frombuffer(batch.column(4)[r].as_py(), dtype=np.uint32 if batch.column(5)[r].as_py() == 4 else np.int64).astype(np.int64)
                first, size = np.zeros(len(items.terms), dtype=np.int64), np.zeros(len(items.terms), dtype=np.int64)
                place = np.searchsorted(items.terms, keys)
                there = (place < len(items.terms)) & (items.terms[np.minimum(place, len(items.terms) - 1)] == keys) if len(items.terms) else np.zeros(len(keys), dtype=bool)
                size[place[there]] = sizes[there]
                first[place[there]] = (np.cumsum(sizes) - sizes)[there]
                covered: dict[tuple[int, int], dict[tuple[int, int], None]] = {}
                for item, lo, hi in _phrases(items, first, size, postings):
                    for d, s, e in zip(np.searchsorted(base, lo, side="right") - 1, lo, hi):
                        covered.setdefault((int(d), int(item)), {})[int(s), int(e)] = None
                out = []
                for (d, item), spans in covered.items():
                    total, until = 0, -1
                    for s, e in sorted(spans):
                        total += max(0, e - max(s, until))
                        until = max(until, e)
                    n = len(items.words[item])
                    out.append((int(doc[d]), int(items.ids[item]), "phrase", min(total, n), min(total, n) / n))
                for item in _likely(items, size).tolist():
                    n = int(items.many[item])
                    for s, _, found in _windows(items.words[item], share, slack, first, size, postings):
                        d = int(np.searchsorted(base, s, side="right")) - 1
                        if (d, item) not in covered:
                            out.append((int(doc[d]), int(items.ids[item]), "proximity", found, found / n))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(list(zip(*out)) or [()] * 5, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "kind", "n_words", "coverage"])

    hits = index.mapInArrow(search, "doc_id long, item_id long, kind string, n_words long, coverage double")
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("kind") == "phrase", "n_words", "coverage")).alias("best"))
    found = best.select("doc_id", "item_id", F.when(F.col("best.col1"), "phrase").otherwise("proximity").alias("kind"), "best.n_words", F.round("best.coverage", 6).alias("coverage"))
    return own_item(own_doc(found, "doc_id"), "item_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that contaminated() reports; rows without an id stay."""
    found = written(contaminated(docs, benchmark, id_col, text_col, **options).select("doc_id").distinct())
    return with_ids(docs, found.withColumnRenamed("doc_id", id_col), id_col, "left_anti")
