"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

A unit is a word without the signs inside it, or the word that a run of three
or more single letters spells, so inserted signs and spaces are gone before
anything is compared; so is a word that spaces cut into two to PIECES pieces, if it begins
as a toxic landmark of about its length and has most of its letters.  A mark stands before its first letter and one behind its
last, so that a clean word that contains an insult is not one.  The kernel
sums, over all subsequences of ORDERS characters that two strings share, DECAY to the power of the characters
that their two spans skip: letters inserted into an insult cost something but
leave most of the value.  It is normalised, and a long word is seen through
overlapping windows, so an insult inside it still counts.

A sentence scores as its worst unit and a document as its worst sentence.  The
machine learns from labelled sentences accordingly: each toxic document's
sentences vote through the unit that is the most toxic so far, clean ones
through theirs.  Landmarks are units that set toxic documents apart, and the
clean ones that come closest to them; in the space that they span (Nyström) the SVM is linear, and its decision folds into
one weight a landmark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.langid import svm
from lexigraph.llm.textops import _ALNUM, _LOWER, _WS, U64, Lookup, RollingHash, Texts, ragged, slices, with_ids, within, written

ORDERS, DECAY, LANDMARKS, REVERSE, WINDOW = (3, 4), 0.9, 128, 64, 16
#: The normalised kernel is raised to this power (a kernel again), so that several faint likenesses don't add up to an insult.
POWER = 3
#: Clean units that a round of training takes at most, those nearest to the toxic side.
HARD = 500
#: An insult is this many times as frequent among toxic documents as among clean ones, at least.
LIFT = 8
#: Marks of a word's begin and end, and the bytes of a unit with both.
_BEGIN, _END, WIDTH = 1, 2, WINDOW + 2
#: Share of a landmark's distinct letters that a unit must have; the kernel is 0 below it.
SHARED = 0.75
#: Neighbouring words of a sentence that are read as one at most; such a word has as many letters as a toxic landmark or up to SLACK more.
PIECES, SLACK = 4, 3
#: Labelled documents of each class that are used for training at most, and their characters; the longest are left out.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1000, 2000, 8_000_000
CACHE = 2_000_000

_LETTER = np.zeros(256, dtype=np.uint32)
_LETTER[97:123] = np.uint32(1) << np.arange(26, dtype=np.uint32)
_LETTER[48:58] = np.uint32(1) << np.uint32(26)
_LETTER[128:] = np.uint32(1) << (27 + np.arange(128) % 5).astype(np.uint32)


class Units:
    """The units of some texts: byte ranges in letters, with each one's text and sentence (numbered by text)."""

    def __init__(self, texts: Texts):
        raw = texts.data
        words = texts.words(~_WS)
        keep = _ALNUM[raw]
        self.letters = _LOWER[raw[keep]]
        to = np.concatenate([[0], np.cumsum(keep)])
        start, end = to[words.start], to[words.end]
        # a sentence ends behind . ! ? and at a line end
        mark = np.zeros(256, dtype=np.int64)
        mark[[10, 33, 46, 63]] = 1
        stops = np.concatenate([[0], np.cumsum(mark[raw])])
        text = words.text_of()
        # neither a stop in the word itself nor one in front of the text counts: stops before the word's first byte, from the text's start on
        sentence = stops[words.start] - stops[texts.offsets[:-1]][text]
        some = end > start
        start, end, text, sentence = start[some], end[some], text[some], sentence[some]
        self.pieces = start, end, text, sentence
        # runs of single letters (of one sentence: the stops in "i.d.i.o.t" stand inside a word)
        single = end - start == 1
        step = np.ones(len(start), dtype=bool)
        step[1:] = ~single[1:] | ~single[:-1] | (text[1:] != text[:-1])
        head = np.flatnonzero(step)
        size = np.diff(np.append(head, len(start)))
        run = head[size >= 3]
        last = run + size[size >= 3] - 1
        self.start, self.end = np.concatenate([start, start[run]]), np.concatenate([end, end[last]])
        self.text, self.sentence = np.concatenate([text, text[run]]), np.concatenate([sentence, sentence[run]])
        self.words = len(start)
        self.opens, self.closes = np.ones(len(self.start), dtype=bool), np.ones(len(self.start), dtype=bool)
        # a long unit is seen through overlapping windows
        size = self.end - self.start
        long = np.flatnonzero(size > WINDOW)
        if len(long):
            many = -(-(size[long] - WINDOW) // (WINDOW // 2))
            row, place = ragged(many)
            begin = self.start[long][row] + (place + 1) * (WINDOW // 2)
            finish = np.minimum(begin + WINDOW, self.end[long][row])
            self.end = self.end.copy()
            self.end[long] = self.start[long] + WINDOW
            self.closes[long] = False
            self.opens, self.closes = np.concatenate([self.opens, np.zeros(len(row), dtype=bool)]), np.concatenate([self.closes, place == many[row] - 1])
            self.start, self.end = np.concatenate([self.start, begin]), np.concatenate([self.end, finish])
            self.text, self.sentence = np.concatenate([self.text, self.text[long][row]]), np.concatenate([self.sentence, self.sentence[long][row]])

    def join(self, gate: Gate) -> None:
        """Adds, from place `single` on, the words that two to PIECES neighbouring words of a sentence spell and that pass the gate; letters of neighbours adjoin."""
        start, end, text, sentence = self.pieces
        self.single = len(self.start)
        if not gate.most or len(start) < 2:
            return
        letters = np.bitwise_or.reduceat(_LETTER[self.letters], start)
        mask, alive = letters, np.arange(len(start))
        found = []
        for n in range(1, PIECES):
            alive = alive[alive + n < len(start)]
            last = alive + n
            alive = alive[(end[last] - start[alive] <= gate.most) & (text[last] == text[alive]) & (sentence[last] == sentence[alive])]
            mask = mask.copy()
            mask[alive] |= letters[alive + n]
            ok = alive[gate(self.letters[start[alive]], end[alive + n] - start[alive], mask[alive])]
            found.append((ok, ok + n))
        first, last = (np.concatenate(x) for x in zip(*found))
        self.start, self.end = np.concatenate([self.start, start[first]]), np.concatenate([self.end, end[last]])
        self.text, self.sentence = np.concatenate([self.text, text[first]]), np.concatenate([self.sentence, sentence[first]])
        both = np.ones(len(first), dtype=bool)
        self.opens, self.closes = np.concatenate([self.opens, both]), np.concatenate([self.closes, both])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each distinct unit, an occurrence of it, each unit's place among them)."""
        h = RollingHash(self.letters)(self.start, self.end) + self.opens.astype(U64) + U64(2) * self.closes.astype(U64)
        return np.unique(h, return_index=True, return_inverse=True)

    def padded(self, which: np.ndarray) -> np.ndarray:
        """Rows of these units' bytes with their marks, WIDTH wide; 0 behind the end."""
        out = np.zeros((len(which), WIDTH), dtype=np.uint8)
        start, size, opens = self.start[which], (self.end - self.start)[which], self.opens[which].astype(np.int64)
        out[opens > 0, 0] = _BEGIN
        row, place = ragged(size)
        out[row, place + opens[row]] = self.letters[start[row] + place]
        closes = np.flatnonzero(self.closes[which])
        out[closes, (opens + size)[closes]] = _END
        return out


def pad_strings(strings: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(s[:WIDTH].ljust(WIDTH, b"\0"), dtype=np.uint8) for s in strings], dtype=np.uint8).reshape(-1, WIDTH)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """The kernel of each row of s with the same row of t; s and t are padded with 0."""
    out = np.zeros(len(s), dtype=np.float32)
    decay = np.float32(DECAY)
    s_size, t_size = (s != 0).sum(axis=1), (t != 0).sum(axis=1)
    order = np.lexsort((s_size, t_size))
    for lo in range(0, len(order), chunk):
        rows = order[lo : lo + chunk]
        ls, lt = int(s_size[rows].max()), int(t_size[rows].max())
        a, b = np.ascontiguousarray(s[rows, :ls].T), np.ascontiguousarray(t[rows, :lt].T)
        n = len(rows)
        # prefix[k][j]: the value of common subsequences of k characters with their tails up to (i, j)
        top = max(ORDERS)
        prefix = np.zeros((top, lt + 1, n), dtype=np.float32)
        prefix[0] = 1
        total = np.zeros(n, dtype=np.float32)
        for i in range(ls):
            same = (b == a[i]) & (a[i] != 0)
            for k in range(top, 0, -1):
                gain = same * prefix[k - 1, :-1]
                if k in ORDERS:
                    total += gain.sum(axis=0)
                if k == top:
                    continue
                for j in range(1, lt):
                    gain[j] += decay * gain[j - 1]
                prefix[k] *= decay
                prefix[k, 1:] += gain
        out[rows] = total
    return out


def _masks(rows: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce(_LETTER[rows], axis=1)


class Gate:
    """What a word out of pieces must have to be worth the kernel: a toxic landmark's first letter, about its length and a SHARED part of its letters."""

    def __init__(self, landmarks: np.ndarray):
        size = (landmarks > _END).sum(axis=1)
        whole = landmarks[(landmarks[:, 0] == _BEGIN) & (landmarks == _END).any(axis=1) & (size >= max(ORDERS))]
        size, mask = (whole > _END).sum(axis=1), _masks(whole)
        self.by_first: dict[int, list[tuple[int, np.uint32, int]]] = {}
        for row, n, m in zip(whole, size, mask):
            self.by_first.setdefault(int(row[1]), []).append((int(n), m, int(np.ceil(SHARED * np.bitwise_count(m)))))
        self.most = min(WINDOW, int(size.max()) + SLACK) if len(whole) else 0

    def __call__(self, first: np.ndarray, size: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), dtype=bool)
        for letter, marks in self.by_first.items():
            at = np.flatnonzero(first == letter)
            for n, m, least in marks:
                out[at] |= (size[at] >= n) & (size[at] <= n + SLACK) & (np.bitwise_count(mask[at] & m) >= least)
        return out


@dataclass
class Kernel:
    """Normalised kernel values against landmarks."""

    landmarks: np.ndarray

    def __post_init__(self):
        self.mask = _masks(self.landmarks)
        self.least = np.ceil(SHARED * np.bitwise_count(self.mask)).astype(np.uint8)
        self.own = np.maximum(subsequence_kernel(self.landmarks, self.landmarks), 1e-9)

    def pairs(self, rows: np.ndarray, chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, landmark, value) where the value may not be 0."""
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))]
        for lo in range(0, len(rows), chunk):
            some = rows[lo : lo + chunk]
            mask = _masks(some)
            hits = [np.flatnonzero(np.bitwise_count(mask & self.mask[m]) >= self.least[m]) for m in range(len(self.landmarks))]
            u = np.concatenate([*hits, np.zeros(0, np.int64)])
            m = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
            near, of = np.unique(u, return_inverse=True)
            own = np.maximum(subsequence_kernel(some[near], some[near]), 1e-9)[of]
            value = (subsequence_kernel(some[u], self.landmarks[m]) / np.sqrt(own * self.own[m])) ** POWER
            parts.append(((u + lo).astype(np.int32), m.astype(np.int32), value.astype(np.float32)))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(self.landmarks)), dtype=np.float32)
        u, m, value = self.pairs(rows)
        out[u, m] = value
        return out


@dataclass
class Model:
    landmarks: np.ndarray
    weight: np.ndarray
    offset: float

    def __post_init__(self):
        self.kernel = Kernel(self.landmarks)
        score = self.score(self.landmarks)
        self.gate = Gate(self.landmarks[score > 0])
        # chance makes far more words out of pieces than there are words, so these must come halfway to a landmark
        self.margin = 0.5 * float(score[score > 0].min(initial=np.inf)) if (score > 0).any() else 0.0

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The decision value of each unit; toxic above 0."""
        u, m, value = self.kernel.pairs(rows)
        return np.bincount(u, weights=self.weight[m] * value, minlength=len(rows)) + self.offset


def _landmarks(words: list[bytes], evidence: np.ndarray, n: int) -> np.ndarray:
    """Up to n units of the strongest evidence, passing over those that are nearly one already taken."""
    rows = pad_strings([words[k] for k in np.argsort(-evidence, kind="stable")[: 8 * n]])
    taken: list[int] = []
    for k in range(len(rows)):
        if taken:
            near = subsequence_kernel(np.repeat(rows[k][None], len(taken), axis=0), rows[taken])
            own = subsequence_kernel(rows[[k, *taken]], rows[[k, *taken]])
            if (near > 0.6 * np.sqrt(own[0] * own[1:])).any():
                continue
        taken.append(k)
        if len(taken) == n:
            break
    return rows[taken]


def stuffed(words: np.ndarray, letters: bytes = b"xqa") -> np.ndarray:
    """Each word with one letter put in, or one doubled, at each inner place."""
    out = []
    for row in words:
        word = row[row != 0].tobytes()
        inner = range(2 if word[0] == _BEGIN else 1, len(word) - (word[-1] == _END))
        out += [word[:k] + letter + word[k:] for k in inner for letter in (*(letters[c : c + 1] for c in range(len(letters))), word[k - 1 : k])]
    return pad_strings(out)


def train_on(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, reverse: int = REVERSE, rounds: int = 4) -> Model:
    """A model from documents and whether each is toxic; without both kinds, one that finds nothing toxic."""
    toxic = np.asarray(toxic, dtype=bool)
    nothing = Model(np.zeros((0, WIDTH), dtype=np.uint8), np.zeros(0), -1.0)
    if toxic.all() or not toxic.any():
        return nothing
    # slice by slice, so that temporary arrays stay small: distinct units, and where each occurs
    found: list[tuple[np.ndarray, ...]] = []
    for lo, _, part in slices(pa.array(texts, pa.string()), 1 << 19):
        units = Units(part)
        hashes, seen, place = units.distinct()
        where = np.unique((units.text + lo).astype(np.int64) << 32 | units.sentence, return_inverse=True)
        pairs = np.unique(where[1].astype(np.int64) * len(hashes) + place) if len(hashes) else np.zeros(0, dtype=np.int64)
        # the word in front tells occurrences in copies of one text from independent ones
        before = np.zeros(len(units.start), dtype=U64)
        before[1 : units.words] = np.where(units.text[1 : units.words] == units.text[: units.words - 1], hashes[place[: units.words - 1]], U64(0)) if units.words else U64(0)
        bad = toxic[units.text + lo]
        contexts = np.unique(np.stack([place[bad].astype(U64), before[bad]]), axis=1)
        found.append((hashes, units.padded(seen), where[0][pairs // max(1, len(hashes))], pairs % max(1, len(hashes)), contexts))
    _, first, place = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
    rows = np.concatenate([f[1] for f in found])[first]
    sentence = np.concatenate([f[2] for f in found])
    offsets = np.cumsum([0, *(len(f[0]) for f in found)])
    which = np.concatenate([place[o : o + len(f[0])][f[3]] for o, f in zip(offsets, found)])
    contexts = np.unique(np.concatenate([np.stack([place[o : o + len(f[0])][f[4][0].astype(np.int64)].astype(U64), f[4][1]]) for o, f in zip(offsets, found)], axis=1), axis=1)[0]
    independent = np.bincount(contexts.astype(np.int64), minlength=len(rows))
    del found
    text = sentence >> 32
    # document frequency of each distinct unit among toxic and clean documents
    in_doc = np.unique(which.astype(np.int64) * len(texts) + text)
    unit, doc = in_doc // len(texts), in_doc % len(texts)
    hits, misses = np.bincount(unit[toxic[doc]], minlength=len(rows)), np.bincount(unit[~toxic[doc]], minlength=len(rows))
    # Chernoff's bound: the log of how unlikely so many of a unit's documents are toxic by chance; it must outweigh the number of units
    hits = np.minimum(hits, independent)
    share, p = hits / np.maximum(hits + misses, 1), toxic.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = (hits + misses) * (np.nan_to_num(share * np.log(share / p)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - p))))
    odds = np.where(share > p, odds, -odds)
    size = (rows != 0).sum(axis=1)
    evidence = np.where((size >= max(ORDERS)) & (hits * (~toxic).sum() > LIFT * misses * toxic.sum()) & (odds > np.log(len(rows))), odds, 0)
    if not (evidence > 0).any():
        return nothing
    strong = np.flatnonzero(evidence > 0)
    marks = _landmarks([rows[k][: size[k]].tobytes() for k in strong], evidence[strong], landmarks)
    spread = stuffed(marks)  # landmarks with a letter put in count as toxic too
    bad, score = toxic[text], odds
    for nth in range(rounds):
        # the worst unit of each toxic document, and of each clean sentence
        unit_score = score[which]
        order = np.lexsort((unit_score, text))
        last = order[np.append(text[order][1:] != text[order][:-1], True)]
        witness = np.unique(which[last[bad[last]]])
        witness = witness[evidence[witness] > 0]  # a document may owe its label to none of its words
        order = np.lexsort((unit_score, sentence))
        last = order[np.append(sentence[order][1:] != sentence[order][:-1], True)]
        clean = np.unique(which[last[~bad[last]]])
        clean = clean[evidence[clean] == 0]
        clean = clean[np.argsort(-score[clean], kind="stable")[:HARD]]  # easy ones would outweigh the few that matter
        if not len(witness) or not len(clean):
            return nothing
        if nth == 1:  # the clean units nearest to the toxic side are landmarks too
            closest = clean[np.argsort(-score[clean], kind="stable")[: 8 * reverse]]
            marks = np.concatenate([marks, _landmarks([rows[k][: size[k]].tobytes() for k in closest], score[closest] - score[closest].min() + 1, reverse)])
        if nth < 2:
            kernel = Kernel(marks)
            # Nyström: the map k(., landmarks) W^(-1/2), W the landmarks' kernel
            w = kernel.matrix(marks).astype(np.float64)
            value, vector = np.linalg.eigh((w + w.T) / 2 + 1e-3 * np.eye(len(marks)))
            root = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
            # most units are like no landmark: they share one row of zeros, the last
            unit, mark, worth = kernel.pairs(rows)
            near, at = np.unique(unit, return_inverse=True)
            features = np.zeros((len(near) + 1, len(marks)), dtype=np.float32)
            features[at, mark] = worth
            row_of = np.full(len(rows), len(near))
            row_of[near] = np.arange(len(near))
            extra = kernel.matrix(spread)
        x = np.concatenate([features[row_of[witness]], extra, features[row_of[clean]]]) @ root
        weight, offset = svm(x.astype(np.float32), np.where(np.arange(len(x)) < len(x) - len(clean), 1.0, -1.0), rounds=300)
        folded = (root @ weight).astype(np.float64)
        score = (features @ folded)[row_of] + offset
    # the threshold that errs least: by clean document, and by toxic document and landmark with a letter put in alike
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, text, score[which])
    value = np.concatenate([worst[~toxic], worst[toxic], extra @ folded + offset])
    gain = np.repeat([1 / (~toxic).sum(), -0.5 / toxic.sum(), -0.5 / len(extra)], [(~toxic).sum(), toxic.sum(), len(extra)])
    order = np.argsort(value, kind="stable")
    value = value[order]
    best = int(np.argmax(np.cumsum(gain[order])))
    cut = value[best] if best + 1 == len(value) or not np.isfinite(value[best]) else 0.5 * (value[best] + value[best + 1])
    return Model(marks, folded, offset - float(cut))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", n_toxic: int = TRAIN_TOXIC, n_clean: int = TRAIN_CLEAN) -> Model:
    """A model from at most n_toxic toxic and n_clean clean labelled documents, chosen by a hash of their ids, without the longest if all have more than TRAIN_CHARS characters."""
    ids = labels.select(F.col(id_col).alias("row_id"), (F.col(label_col) > 0).alias("toxic")).dropna().groupBy("row_id").agg(F.max("toxic").alias("toxic"))
    # each task keeps its own least hashes, so no class is sorted as a whole
    some = [ids.where(F.col("toxic") == kind).orderBy(F.xxhash64("row_id"), "row_id").limit(n) for kind, n in ((True, n_toxic), (False, n_clean))]
    chosen = written(some[0].unionByName(some[1]))
    rows = with_ids(docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("words")).dropna(), chosen.select("row_id"), "row_id", "left_semi")
    rows = within(rows, "words", TRAIN_CHARS).orderBy("row_id", "words").collect()
    toxic = {r["row_id"]: r["toxic"] for r in chosen.collect()}
    return train_on([r["words"] for r in rows], np.array([toxic[r["row_id"]] for r in rows]))


class Cache:
    """Scores of units seen before in this process, by hash."""

    def __init__(self):
        self.known, self.score = Lookup(np.zeros(0, dtype=U64)), np.zeros(0)

    def __call__(self, model: Model, units: Units) -> np.ndarray:
        hashes, seen, which = units.distinct()
        at = self.known(hashes)
        new = np.flatnonzero(at < 0)
        score = np.empty(len(hashes))
        score[at >= 0] = self.score[at[at >= 0]]
        score[new] = model.score(units.padded(seen[new]))
        # rebuilding the table costs as much as it has entries, so it grows by doubling
        if len(self.known.keys) < CACHE:
            self.pending.append((hashes[new], score[new]))
            if sum(len(h) for h, _ in self.pending) > max(50_000, len(self.known.keys)):
                keys, first = np.unique(np.concatenate([self.known.keys, *(h for h, _ in self.pending)]), return_index=True)
                self.score = np.concatenate([self.score, *(s for _, s in self.pending)])[first]
                self.known, self.pending = Lookup(keys), []
        return score[which]

    pending: list


_caches: dict[int, Cache] = {}


def _cache_of(model: Model) -> Cache:
    key = hash((model.landmarks.tobytes(), model.weight.tobytes(), model.offset))
    if key not in _caches:
        _caches.clear()
        _caches[key] = Cache()
        _caches[key].pending = []
    return _caches[key]


def toxic_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_toxic, n_sentences) of each row of docs with a toxic sentence; the score is the worst unit's, above 0.

    Null and empty texts have no sentence and are never toxic; ids are passed on as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = shared.value
        score_of = _cache_of(model)
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1), 1 << 23):
                units = Units(texts)
                if not len(units.start):
                    continue
                units.join(model.gate)
                score = score_of(model, units)
                score[units.single :] -= model.margin
                bad = np.flatnonzero(score > 0)
                doc = np.unique(units.text[bad])
                worst = np.full(hi - lo, -np.inf)
                np.maximum.at(worst, units.text[bad], score[bad])
                sentences = np.unique(units.text[bad].astype(np.int64) << 32 | units.sentence[bad])
                n_bad = np.bincount(sentences >> 32, minlength=hi - lo)
                every = np.unique(units.text.astype(np.int64) << 32 | units.sentence) if len(doc) else sentences
                n_all = np.bincount(every >> 32, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(np.round(worst[doc], 6)), pa.array(n_bad[doc]), pa.array(n_all[doc])], names=["doc_id", "score", "n_toxic", "n_sentences"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, score double, n_toxic long, n_sentences long")
