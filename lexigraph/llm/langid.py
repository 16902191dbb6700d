"""Language identification by hierarchical discrimination.

A linear support vector machine for each pair of families votes for a family;
then one for each pair of languages within that family votes for the language.
Features are hashed byte n-grams of the whole text in lower case, as shares of
all its n-grams, so a text's length doesn't matter and its score is a mean of
per-position weights: one table lookup a position and order.

A text is of no learned language if nearly all of its n-grams occur nowhere in
the training rows, and it has enough different ones to tell.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.llm.textops import _LOWER, U64, Texts, slices, with_ids, within, written

ORDERS, BITS = (2, 3, 4), 14
#: Bits of the finer buckets that tell whether an n-gram was seen in training.
FINE = 22
#: A text is rejected if more than this share of its n-grams is unseen, and if it has this many different ones.
UNSEEN, EVIDENCE = 0.5, 100
#: Labelled rows of each language, and of all together, that a model is fitted on at most, and their characters; the longest are left out.
TRAIN_PER_LANG, TRAIN_ROWS, TRAIN_CHARS = 300, 3000, 8_000_000
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl", "be", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
UNKNOWN = "und"


def family(lang: str) -> str:
    """The family of a language code; a language of no listed family is a family of its own."""
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _grams(texts: Texts, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram that begins at each byte (-1 past a text's end), and which texts have a letter."""
    data = _LOWER[texts.data]
    # runs of anything but letters count as one space
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    data = np.where(letter, data, 32).astype(U64)
    ends = np.repeat(texts.offsets[1:], np.diff(texts.offsets))
    place = np.arange(len(data))
    out, code = [], data.copy()
    for n in range(2, max(ORDERS) + 1):
        code = code[: len(data) - n + 1] << U64(8) | data[n - 1 :] if len(data) >= n else np.zeros(0, dtype=U64)
        if n in ORDERS:
            bucket = np.full(len(data), -1, dtype=np.int32)
            bucket[: len(code)] = ((code + U64(n << 40)) * U64(0x9E3779B97F4A7C15) >> U64(64 - bits)).astype(np.int32)
            bucket[place + n > ends] = -1
            bucket[:-1][~letter[:-1] & ~letter[1:]] = -1
            bucket[-1:] = -1
            out.append(bucket)
    some = np.concatenate([[0], np.cumsum(letter)])
    return out, some[texts.offsets[1:]] > some[texts.offsets[:-1]]


def features(texts: Texts) -> np.ndarray:
    """Shares of each bucket among a text's n-grams."""
    grams, _ = _grams(texts)
    x = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for k, (lo, hi) in enumerate(zip(texts.offsets.tolist(), texts.offsets[1:].tolist())):
        for bucket in grams:
            some = bucket[lo:hi]
            x[k] += np.bincount(some[some >= 0], minlength=1 << BITS)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    return x


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear SVM (squared hinge, balanced classes), by accelerated gradient steps; y is +1 or -1."""
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    penalty, one = np.float32(penalty), np.float32(1)
    w, b = np.zeros(x.shape[1], dtype=np.float32), np.float32(0)
    vw, vb, t = w, b, 1.0
    rate = np.float32(1 / (2 * (np.einsum('ij,ij->i', x, x).max(initial=1e-12) + 1) + penalty))
    for _ in range(rounds):
        slack = np.maximum(0, one - y * (x @ vw + vb)) * weight
        nw = vw - rate * (penalty * vw - 2 * (slack * y) @ x)
        nb = vb + rate * 2 * (slack * y).sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        step = np.float32((t - 1) / nt)
        vw, vb = nw + step * (nw - w), nb + step * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    #: Of each machine: ('family', a, b) or ('lang', a, b), a positive score votes for a.
    machines: list[tuple[str, str, str]]
    table: np.ndarray  # (buckets, machines)
    offset: np.ndarray
    #: Bits of the FINE buckets that occur in the training rows.
    seen: np.ndarray

    def scores(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(texts x machines) scores, and which texts have a letter."""
        return self._read(texts)[:2]

    def _read(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """scores() and which texts are of no learned language."""
        fine, some = _grams(texts, FINE)
        grams = [g >> (FINE - BITS) for g in fine]  # -1 stays
        total = np.zeros((len(texts), len(self.machines)))
        count, unseen = np.zeros(len(texts)), np.zeros(len(texts))
        new = [(g >= 0) & (self.seen[g >> 3] >> (7 - (g & 7)).astype(np.uint8) & 1 == 0) for g in fine]
        full = np.flatnonzero(np.diff(texts.offsets))
        table = np.concatenate([self.table, np.zeros((1, len(self.machines)), dtype=np.float32)])  # bucket -1
        begin = texts.offsets[:-1][full]
        for bucket, first in zip(grams, new):
            unseen[full] += np.add.reduceat(first, begin, dtype=np.int64)
            count[full] += np.add.reduceat(bucket >= 0, begin, dtype=np.int64)
            for m in range(len(self.machines)):
                total[full, m] += np.add.reduceat(table[bucket, m], begin, dtype=np.float64)
        strange = unseen > UNSEEN * count
        for k in np.flatnonzero(strange):
            lo, hi = texts.offsets[k], texts.offsets[k + 1]
            strange[k] = sum(len(np.unique(g[lo:hi][x[lo:hi]])) for g, x in zip(fine, new)) >= EVIDENCE
        return total / np.maximum(count, 1)[:, None] + self.offset, some, strange

    def predict(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(place in langs or -1, least margin of the winner's votes)."""
        scores, some, strange = self._read(texts)
        some = some & ~strange
        n = len(texts)

        def vote(level: str, names: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            votes, margin = np.zeros((len(rows), len(names))), np.full((len(rows), len(names)), np.inf)
            for m, (kind, a, b) in enumerate(self.machines):
                if kind == level and a in names and b in names:
                    for name, s in ((a, scores[rows, m]), (b, -scores[rows, m])):
                        k = names.index(name)
                        votes[:, k] += s > 0
                        margin[:, k] = np.minimum(margin[:, k], s)
            best = np.lexsort((np.where(np.isinf(margin), 0, margin).T, votes.T), axis=0)[-1] if len(names) > 1 else np.zeros(len(rows), dtype=np.int64)
            return best, margin[np.arange(len(rows)), best]

        lang, margin = np.full(n, -1), np.zeros(n)
        fam, first = vote("family", self.families, np.arange(n))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero((fam == k) & some)
            names = [x for x in self.langs if family(x) == f]
            best, second = vote("lang", names, rows)
            lang[rows] = np.array([self.langs.index(x) for x in names])[best]
            margin[rows] = np.minimum(first[rows], second)
        return lang, np.where(np.isinf(margin), 0, margin)


def train_on(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    families = sorted({family(x) for x in names})
    (_, _, part), *rest = list(slices(pa.array(texts, pa.string()), 1 << 62)) or [(0, 0, Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64)))]
    x, lang = features(part), np.array(langs)
    fam = np.array([family(x) for x in langs])
    machines, tables, offsets = [], [], []
    for kind, labels, pairs in (("family", fam, combinations(families, 2)), ("lang", lang, (p for p in combinations(names, 2) if family(p[0]) == family(p[1])))):
        for a, b in pairs:
            rows = np.flatnonzero((labels == a) | (labels == b))
            scale = np.float32(100)
            w, o = svm(x[rows] * scale, np.where(labels[rows] == a, 1.0, -1.0))
            machines.append((kind, a, b))
            tables.append(w * scale)
            offsets.append(o)
    table = np.stack(tables, axis=1).astype(np.float32) if tables else np.zeros((1 << BITS, 0), dtype=np.float32)
    seen = np.zeros(1 << FINE, dtype=bool)
    for g in _grams(part, FINE)[0]:
        seen[g[g >= 0]] = True
    return Model(names, families, machines, table, np.array(offsets), np.packbits(seen))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> Model:
    """A model fitted on at most per_lang labelled rows of each language (fewer of each of many, so that all are at most TRAIN_ROWS), chosen by a hash of their ids; rows without a label, id or text aren't used, nor the longest if all have more than TRAIN_CHARS characters."""
    ids = docs.select(F.col(id_col).alias("row_id"), F.col(lang_col).alias("label")).dropna()
    per_lang = min(per_lang, max(1, TRAIN_ROWS // max(1, ids.select("label").distinct().count())))
    order = Window.partitionBy("label").orderBy(F.xxhash64("row_id"), "row_id")
    chosen = written(ids.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_lang).select("row_id").distinct())
    rows = with_ids(docs.select(F.col(id_col).alias("row_id"), F.col(lang_col).alias("label"), F.col(text_col).alias("words")).dropna(), chosen, "row_id", "left_semi")
    rows = within(rows, "words", TRAIN_CHARS).orderBy("row_id", "label", "words").collect()
    return train_on([r["words"] for r in rows], [r["label"] for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, predicted, family, margin) for each row of docs.

    predicted is 'und', with family null and margin 0, for a text without a
    letter (null and empty ones too), for one of no learned language and where no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = shared.value
        names = pa.array([*model.langs, UNKNOWN], pa.string())
        homes = pa.array([*map(family, model.langs), None], pa.string())
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                lang, margin = model.predict(texts) if model.langs else (np.full(hi - lo, -1), np.zeros(hi - lo))
                at = pa.array(np.where(lang < 0, len(model.langs), lang))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), names.take(at), homes.take(at), pa.array(np.round(margin, 6))], names=["doc_id", "predicted", "family", "margin"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, predicted string, family string, margin double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose language can't be told, which are those without a letter and those of no learned language; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for lo, hi, texts in slices(batch.column(place)):
                keep[lo:hi] = model.predict(texts)[0] >= 0 if model.langs else False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
