"""Repeated passages across documents, by a blockwise suffix sort with a difference cover.

Words are symbols, a document is a string of them, and a suffix is a (document,
position).  Wanted are all passages of at least min_words words that occur in
two documents or more, which are the suffixes that tie with another document's
to that depth.

1. Filter.  Of the positions in a difference cover D modulo v the prefixes of
   min_words - v + 1 words are matched by their hashes, one bucket of hashes at
   a time.  Two suffixes that tie have some shift below v that puts both in the
   cover, so one whose next cover positions match no other document's is alone;
   equal words have equal hashes, so none is lost.
2. Blocks.  A task sorts the suffixes left in some megabytes of text (see
   `suffix_sort`).  Of those that tie the least goes on, marked as a sure
   repeat, and the others are done, so a passage that a large share of all
   documents holds comes to one suffix a block.
3. Buckets.  A suffix's bucket is the least hash among the short word runs of
   its first min_words words, which equal suffixes share and neighbouring ones
   mostly do; so whole stretches of text go to a bucket.  Ranges of that hash
   part a bucket, and a part is sorted like a block, one at a time.

A block or bucket is sorted exactly, by words: words are named in their byte
order, names are doubled up to v words, and suffixes are sorted by those.  Ties
are resolved by the ranks of the bucket's own cover sample, sorted first: for
any two suffixes some shift below v puts both in the sample.  Hashes filter and
route, and decide nothing.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.textops import _LOWER, _WS, U64, RollingHash, Texts, Words, binaries, buckets, key_buckets, keyed, longs, mix, ragged, slices, split_by, unused, whitespace_words, with_ids, written

#: Perfect difference sets: every residue is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
MIN_WORDS = 50
#: Cover prefixes that a task gathers before it sends them on.
FLUSH = 1 << 18
#: Words of a block, which has 16 bytes for each at most; its last piece may go beyond either by as much again.
BLOCK = 1 << 18
#: Bytes of text for each bucket, and for each part of one, of which one is sorted at a time.
BUCKET_BYTES, PART_BYTES = 16 << 20, 1 << 20
#: Bytes of the slices in which texts are hashed, which takes some fifty times as much.
SLICE = (1 << 19) - 1024
#: Words of the runs by which suffixes find their bucket.
ROUTE = 8


def cover(min_words: int, share: float) -> tuple[int, tuple[int, ...]]:
    v = max(v for v in COVERS if v == 1 or v <= share * min_words)
    return v, COVERS[v]


@cache
def shifts(v: int) -> np.ndarray:
    """For each pair of residues the least shift that puts both in the cover."""
    inside = np.zeros(v, dtype=bool)
    inside[list(COVERS[v])] = True
    r = np.arange(v)
    both = inside[(r[:, None, None] + r) % v] & inside[(r[None, :, None] + r) % v]
    return both.argmax(axis=2)


def symbols(words: Words) -> np.ndarray:
    """A number for each word, the same for the same bytes only, and in the order of their bytes; ASCII case doesn't count."""
    data = words.texts.data
    offsets = np.append(0, np.cumsum(words.end - words.start))
    plain = _LOWER[data[~_WS[data]]]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(plain)]).dictionary_encode()
    rank = np.empty(len(coded.dictionary), dtype=np.int64)
    rank[pa.compute.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    return rank[coded.indices.to_numpy()]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of the pairs, in their order."""
    return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1].astype(np.int64, copy=False)


def suffix_sort(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes as places of words, where another prefix of depth words begins) in lexicographic order to that depth, of all that are so long in their text."""
    count, n = np.diff(words.first), len(words)
    text, place = ragged(count)
    left = count[text] - place
    v, members = cover(depth, 1 / 3)
    name, length = symbols(words), 1
    while length < v:
        step = min(length, v - length)
        name = _pairs(name, np.append(name[step:], np.zeros(step, dtype=np.int64))[:n])
        length += step
    # the cover sample, ranked so deep that with the first and the last v words it decides
    inside = np.zeros(v, dtype=bool)
    inside[list(members)] = True
    known = depth - v + 1
    sample = np.flatnonzero(inside[np.arange(n) % v] & (left >= known))
    value, done = name[sample], v
    while done < known:
        step = min(v, known - done)
        value = _pairs(value, name[sample + done + step - v])
        done += step
    rank = np.full(n, -1, dtype=np.int64)
    rank[sample] = value
    order = np.flatnonzero(left >= depth)
    order = order[np.argsort(name[order], kind="stable")]
    head = name[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = head[1:] != head[:-1]
    group, shift = np.cumsum(new), shifts(v)
    alone = new & np.append(new[1:], True)
    todo = np.flatnonzero(~alone)
    group = group[todo]
    while len(todo):  # ties: split each group by a pivot
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(todo)))
        mine, pivot = order[todo], np.repeat(order[todo[first + size // 2]], size)
        k = shift[mine % v, pivot % v]
        side = np.sign(rank[mine + k] - rank[pivot + k])
        level = side == 0
        side[level] = np.sign(name[mine[level] + depth - v] - name[pivot[level] + depth - v])
        key = group * 3 + side
        by = np.argsort(key, kind="stable")
        order[todo], key, side = mine[by], key[by], side[by]
        cut = np.append(True, key[1:] != key[:-1])
        new[todo[cut]] = True
        open_ = (side != 0) & ~(cut & np.append(cut[1:], True))
        todo, group = todo[open_], np.cumsum(cut)[open_]
    return order, new


def _repeats_of(words: Words, doc: np.ndarray, start: np.ndarray, sure: np.ndarray | None, depth: int):
    """For each suffix of depth words, by its place: (place of its word, document, position, repeated, least of those it ties with). A tie is repeated if two documents are in it or one is sure."""
    order, new = suffix_sort(words, depth)
    text, place = ragged(np.diff(words.first))
    d, p = doc[text[order]], start[text[order]] + place[order]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    tied, least = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    if len(first):
        low = np.minimum.reduceat(d, first)
        two = low < np.maximum.reduceat(d, first)
        if sure is not None:
            by_place = np.zeros(len(words), dtype=bool)
            by_place[np.sort(order)] = sure
            two |= np.logical_or.reduceat(by_place[order], first)
        at_low = d == np.repeat(low, size)
        spot = np.minimum.reduceat(np.where(at_low, p, np.iinfo(np.int64).max), first)
        tied, least = np.repeat(two, size), at_low & (p == np.repeat(spot, size))
    back = np.argsort(order)
    return order[back], d[back], p[back], tied[back], least[back]


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive entries."""
    length = 1
    while length < width:
        step = min(length, width - length)
        x = np.minimum(x, np.append(x[step:], np.full(step, np.iinfo(U64).max, dtype=U64))[: len(x)])
        length += step
    return x


_PIECES = "bucket int, part int, docs binary, starts binary, sizes binary, sure binary, text binary"


def _block(n: int, pieces: list[tuple[int, int, np.ndarray]], depth: int, parts: int = 1):
    """Sorts a block of pieces (document, position of the first word, bytes); a batch of one row for each part of a bucket. From bucket n on rows have repeats that aren't the least of the block, by document."""
    doc, start = np.array([x[0] for x in pieces], dtype=np.int64), np.array([x[1] for x in pieces], dtype=np.int64)
    offsets = np.cumsum([0, *(len(x[2]) for x in pieces)])
    words = whitespace_words(Texts(np.concatenate([x[2] for x in pieces]), offsets))
    at, d, p, tied, least = _repeats_of(words, doc, start, None, depth)
    done = tied & ~least
    heads, (docs, places) = split_by(n + key_buckets(mix(d[done].view(U64)), n), d[done], p[done])
    rows = [(b, 0, x.tobytes(), y.astype(np.int32).tobytes(), None, None, None) for b, x, y in zip(heads, docs, places)]
    go = ~done
    at, d, p, tied = at[go], d[go], p[go], tied[go]
    if len(at):
        run = min(ROUTE, depth)
        hashes = words.hashes()
        grams = np.full(len(words), np.iinfo(U64).max, dtype=U64)
        head = np.arange(len(words) - run + 1)
        grams[: len(head)] = RollingHash(hashes)(head, head + run)
        bucket = key_buckets(mix(_least_of(grams, depth - run + 1)[at]), n * parts)
        text = np.repeat(np.arange(len(doc)), np.diff(words.first))[at]
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])]))
        last = np.append(cut[1:], len(at)) - 1
        lo, hi = words.start[at[cut]], words.end[at[last] + depth - 1]
        heads, (docs, starts, los, his) = split_by(bucket[cut], d[cut], p[cut], lo, hi)
        _, (sure,) = split_by(bucket, tied)
        blob = words.texts.data.tobytes()
        for b, x, y, s, e, marks in zip(heads, docs, starts, los, his, sure):
            rows.append((b // parts, b % parts, x.tobytes(), y.astype(np.int32).tobytes(), (e - s).astype(np.int32).tobytes(), marks.tobytes(), b"".join(blob[i:j] for i, j in zip(s.tolist(), e.tolist()))))
    columns = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:2]), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["bucket", "part", "docs", "starts", "sizes", "sure", "text"])


def _bucket(table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts a bucket of pieces, part by part; (document, position, is least) of the suffixes that repeat."""
    if table.column("text")[0].as_py() is None:
        doc, start = _load(table, ("docs", np.int64), ("starts", np.int32))
        return doc, start, np.zeros(len(doc), dtype=bool)
    part = table.column("part")
    found = [_part(table.filter(pa.compute.equal(part, k)), depth) for k in part.unique()]
    return tuple(np.concatenate(x) for x in zip(*found))


def _part(table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, start = _load(table, ("docs", np.int64), ("starts", np.int32))
    size, sure = _load(table, ("sizes", np.int32), ("sure", np.bool_))
    data = np.frombuffer(b"".join(table.column("text").to_pylist()), dtype=np.uint8)
    words = whitespace_words(Texts(data, np.append(0, np.cumsum(size, dtype=np.int64))))
    _, d, p, tied, least = _repeats_of(words, doc, start.astype(np.int64), sure, depth)
    return d[tied], p[tied], least[tied]


def _load(table: pa.Table, *columns: tuple[str, type]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]) for name, kind in columns]


def _by_document(n: int, doc: np.ndarray, pos: np.ndarray, least: np.ndarray) -> pa.Table:
    heads, (docs, places, marks) = split_by(key_buckets(mix(doc.view(U64)), n), doc, pos, least)
    return pa.table([pa.array(heads, pa.int32()), binaries(docs), binaries([p.astype(np.int32) for p in places]), binaries(marks)], names=["bucket", "owners", "places", "least"])


_OWNERS = "bucket int, owners binary, places binary, least binary"


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, pos, least = _load(table, ("owners", np.int64), ("places", np.int32), ("least", np.bool_))
    order = np.lexsort((pos, doc))
    return doc[order], pos[order], least[order]


def _matches(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of those that share a key with another, by key; where groups begin; whether each has two documents)."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    starts = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    length = np.diff(np.append(starts, len(key)))
    many = length > 1
    order, length = order[np.repeat(many, length)], length[many]
    first = np.cumsum(length) - length
    d = doc[order]
    return order, first, np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first) if len(first) else np.zeros(0, dtype=bool)


def _emit(n: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """A batch of one row for each bucket of cover prefixes: their keys, documents (as differences), positions and marks of sure matches; from bucket n on, matches by document. A key that several documents of the task share goes on once."""
    key, doc, pos = (np.concatenate(x) for x in zip(*parts))
    order, first, two = _matches(key, doc)
    sure, local = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    local[order] = np.repeat(two, np.diff(np.append(first, len(order))))
    sure[order[first[two]]] = True
    local[sure] = False
    bucket = np.where(local, n + key_buckets(mix(doc.view(U64)), n), key_buckets(key, n))
    heads, (keys, docs, places, marks) = split_by(bucket, key, doc, pos, sure)
    keys = [k if b < n else k[:0] for b, k in zip(heads, keys)]
    return pa.RecordBatch.from_arrays([pa.array(heads, pa.int32()), binaries(keys), binaries([np.diff(d, prepend=0) for d in docs]), binaries([p.astype(np.int32) for p in places]), binaries(marks)], names=["bucket", "keys", "docs", "places", "sure"])


_BUCKETS = "bucket int, keys binary, docs binary, places binary, sure binary"


def _matched(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(document, position) of the bucket's cover prefixes that match another document's."""
    key, pos, sure = _load(table, ("keys", U64), ("places", np.int32), ("sure", np.bool_))
    doc = np.concatenate([np.cumsum(np.frombuffer(x, dtype=np.int64)) for x in table.column("docs").to_pylist()])
    if not len(key):  # found by the task that read them
        return doc, pos
    order, first, two = _matches(key, doc)
    two = two | np.logical_or.reduceat(sure[order], first) if len(first) else two
    hit = sure.copy()
    hit[order] = np.repeat(two, np.diff(np.append(first, len(order))))
    return doc[hit], pos[hit]


def _sample(docs: DataFrame, id_col: str, text_col: str, min_words: int, n: int) -> DataFrame:
    v, members = cover(min_words, 0.65)
    depth = min_words - v + 1
    in_cover = np.zeros(v, dtype=bool)
    in_cover[list(members)] = True

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            ids, _ = longs(batch.column(0))
            for lo, hi, texts in slices(batch.column(1), SLICE):
                words = whitespace_words(texts)
                count = np.diff(words.first)
                local = np.arange(len(words)) - np.repeat(words.first[:-1], count)
                at = np.flatnonzero(in_cover[local % v] & (local + depth <= np.repeat(count, count)))
                if len(at):
                    parts.append((RollingHash(words.hashes())(at, at + depth), np.repeat(ids[lo:hi], count)[at], local[at]))
                    size += len(at)
                if size >= FLUSH:
                    yield _emit(n, parts)
                    parts, size = [], 0
        if size:
            yield _emit(n, parts)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, _BUCKETS)


def _candidates(docs: DataFrame, id_col: str, text_col: str, min_words: int, n: int, parts: int = 1) -> DataFrame:
    """The sorted blocks of the suffixes that the matched cover positions (column ranked) admit."""
    v, _ = cover(min_words, 0.65)

    def run(batches):
        pieces, size, held = [], 0, 0
        step = max(1, BLOCK - min_words + 1)
        for batch in batches:
            ids, _ = longs(batch.column(0))
            ranked = [np.frombuffer(x, dtype=np.int32) for x in batch.column(2).to_pylist()]
            for lo, hi, texts in slices(batch.column(1), SLICE):
                words = whitespace_words(texts)
                count, first = np.diff(words.first), words.first[:-1]
                marks = np.zeros(len(words) + v + 1, dtype=np.int32)
                marks[np.concatenate([r + f for r, f in zip(ranked[lo:hi], first)]) + 1] = 1
                marks = np.cumsum(marks)
                text, local = ragged(count)
                ok = (marks[v : v + len(words)] - marks[: len(words)] > 0) & (local + min_words <= count[text])
                heads = np.flatnonzero(ok & (np.append(True, ~ok[:-1]) | (local == 0)))
                tails = np.flatnonzero(ok & (np.append(~ok[1:], True) | (local + 1 == count[text])))
                # the words alone, each with one blank behind it, in lower case
                blank = np.zeros(len(texts.data) + 1, dtype=bool)
                blank[words.end] = True
                blank = blank[:-1] & _WS[texts.data]
                keep = ~_WS[texts.data] | blank
                plain = np.where(blank, 32, _LOWER[texts.data])[keep].astype(np.uint8)
                before = np.append(0, np.cumsum(keep))
                for a, z in zip(heads.tolist(), tails.tolist()):
                    for b in range(a, z + 1, step):
                        e = min(z, b + step - 1)
                        pieces.append((int(ids[lo + text[a]]), int(local[b]), plain[before[words.start[b]] : before[words.end[e + min_words - 1]]].copy()))  # a view would hold its whole slice
                        size, held = size + e - b + min_words, held + len(pieces[-1][2])
                        if size >= BLOCK or held >= 16 * BLOCK:
                            yield _block(n, pieces, min_words, parts)
                            pieces, size, held = [], 0, 0
        if size:
            yield _block(n, pieces, min_words, parts)

    return docs.select(F.col(id_col), F.col(text_col), "ranked").mapInArrow(run, _PIECES)


def _repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(bucket, owners, places, least): all repeated windows, by buckets of documents; ids of docs must be distinct longs and not null."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(buckets(docs.sparkSession), min(size // BUCKET_BYTES, 1 << 29))
    parts = max(1, min(size // (n * PART_BYTES), (1 << 30) // n))

    def matched(_, table):
        doc, pos = _matched(table)
        return _by_document(n, doc, pos, np.zeros(len(doc), dtype=bool))

    def ranked(_, table):
        doc, pos, _ = _documents(table)
        cuts = np.flatnonzero(np.diff(doc)) + 1
        return pa.table([pa.array(doc[np.concatenate([[0], cuts])] if len(doc) else doc), binaries(np.split(pos, cuts) if len(doc) else [])], names=["owner", "ranked"])

    def ties(_, table):
        return _by_document(n, *_bucket(table, min_words))

    sample = _sample(docs, id_col, text_col, min_words, n).groupBy("bucket").applyInArrow(matched, _OWNERS)
    ranks = written(sample.groupBy("bucket").applyInArrow(ranked, "owner long, ranked binary"))
    candidates = with_ids(docs.select(F.col(id_col).alias("owner"), F.col(text_col).alias("words")), ranks.select("owner"), "owner", "left_semi").join(ranks, "owner")
    return _candidates(candidates, "owner", "words", min_words, n, parts).groupBy("bucket").applyInArrow(ties, _OWNERS)


def _spans(doc: np.ndarray, pos: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions (document, start, end) of the windows that begin at these sorted positions."""
    if not len(doc):
        return doc, pos.astype(np.int64), pos.astype(np.int64)
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > min_words)])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], pos[first].astype(np.int64), pos[last].astype(np.int64) + min_words


def cut_spans(doc: np.ndarray, pos: np.ndarray, least: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches (document, start, end) that windows cover which aren't the least, without the words of those that are."""
    parts = []
    for keep in (False, True):
        d, s, e = _spans(doc[least == keep], pos[least == keep], min_words)
        one = np.ones(len(d), dtype=np.int64)
        parts += [(d, s, one * (not keep), one * keep), (d, e, -one * (not keep), -one * keep)]
    d, x, cut, kept = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((x, d))
    d, x = d[order], x[order]
    open_ = (np.cumsum(cut[order]) > 0) & (np.cumsum(kept[order]) == 0)
    at = np.flatnonzero(open_[:-1] & (x[1:] > x[:-1])) if len(x) else np.zeros(0, dtype=np.int64)
    return d[at], x[at], x[at + 1]


def _searchable(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    return rows.select(key, text_col).where(F.col(key).isNotNull() & F.col(text_col).isNotNull())


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the stretches of each document covered by passages of min_words words or more that another document has too.

    Words are separated by ASCII white space, compared without regard to ASCII
    case, and counted from 0; end_word is exclusive.  Null, empty and short
    texts and rows without an id have no passages.  A document is an id with a
    text: rows that repeat both are one, texts that share an id are several.
    Ids of any orderable type will do.
    """

    def spans(_, table):
        doc, pos, _ = _documents(table)
        d, s, e = _spans(doc, pos, min_words)
        return pa.table([pa.array(x) for x in (d, s, e, e - s)], names=["doc_id", "start_word", "end_word", "n_words"])

    rows, key, own = keyed(docs.select(id_col, text_col), id_col, text_col)
    found = _repeats(_searchable(rows, key, text_col), key, text_col, min_words)
    return own(found.groupBy("bucket").applyInArrow(spans, "doc_id long, start_word long, end_word long, n_words long"), "doc_id")


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the repeats of passages: of each repeated window the occurrence in the least (id, position) stays, the others' words are cut unless they belong to a window that stays.

    A document of which no word is left goes; every other one keeps its row,
    and its text unchanged if nothing was cut.  A column n_chars is set anew
    for changed texts.  Rows without an id or a text stay.  A document is an id
    with a text: rows that repeat both become one, texts that share an id are
    several.  Ids of any orderable type will do.
    """
    rows, key, _ = keyed(docs, id_col, text_col)

    def cuts(_, table):
        d, s, e = cut_spans(*_documents(table), min_words)
        breaks = np.flatnonzero(np.diff(d)) + 1
        both = np.stack([s, e], axis=1).astype(np.int32)
        return pa.table([pa.array(d[np.concatenate([[0], breaks])] if len(d) else d), binaries(np.split(both, breaks) if len(d) else [])], names=["cut_id", "cut_spans"])

    cut = written(_repeats(_searchable(rows, key, text_col), key, text_col, min_words).groupBy("bucket").applyInArrow(cuts, "cut_id long, cut_spans binary"))
    ids = cut.select(F.col("cut_id").alias(key))

    def run(batches):
        for batch in batches:
            spans = [np.frombuffer(x, dtype=np.int32).reshape(-1, 2) for x in batch.column(1).to_pylist()]
            out = []
            for lo, hi, texts in slices(batch.column(2)):
                words = whitespace_words(texts)
                for i in range(hi - lo):
                    base, end = texts.offsets[i], texts.offsets[i + 1]
                    starts = words.start[words.first[i] : words.first[i + 1]]
                    keep = np.ones(end - base, dtype=bool)
                    for s, e in spans[lo + i]:
                        keep[starts[s] - base : (starts[e] - base if e < len(starts) else end - base)] = False
                    out.append(texts.data[base:end][keep].tobytes().decode() if keep[starts - base].any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["cut_id", "cut_text"])

    # a name that docs may have too is told apart by a longer one
    new = unused("cut_text", rows.columns)
    source = with_ids(rows.select(F.col(key).alias("cut_id"), F.col(text_col).alias("cut_source")).where("cut_id is not null"), cut.select("cut_id"), "cut_id", "left_semi")
    rest = with_ids(rows, ids, key, "left_anti")
    texts = source.join(cut, "cut_id").select("cut_id", "cut_spans", "cut_source").mapInArrow(run, "cut_id long, cut_text string")
    texts = texts.where("cut_text is not null").select(F.col("cut_id").alias(key), F.col("cut_text").alias(new))
    changed = with_ids(rows, ids, key, "left_semi").join(texts, key).withColumn(text_col, F.col(new))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return rest.select(*docs.columns).unionByName(changed.select(*docs.columns))
