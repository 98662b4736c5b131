"""Language identification with a string kernel.

The kernel of two texts is the cosine of the presence vectors of their character n-grams, n = 1, 2, 3 (the blended
spectrum). Nyström: each language gives some of its sampled documents as landmarks, and a text's features are its
kernel values to all landmarks times the inverse root of the landmarks' own kernel matrix. One ridge regression for
each language against the rest is solved on the sample. Scoring takes a block of documents as a matrix of presence
and multiplies it with the landmarks' matrix, then with the regressions'.

The sample is bounded: ``per_language`` documents of each language at most, those with the lowest hash of ``doc_id``.
An n-gram is a number of 63 bits that its code points, in lower case, make up; so all scripts count alike and whole.

A document is rejected if it has no letter, if too few of its distinct n-grams are known from any landmark (another
language or script, or no language), or if no language leads the next by enough. How much that is comes from the sample:
of each half, pieces of 4 characters and more, and whole texts, are scored by a model of the other half; the share and the
lead that all but ``HELD`` of those of a language and size have are asked of a text that is taken for it, with some slack, as
so small a sample has not met the corpus's extremes (``SLACK``: more unknown n-grams, and a part of the lead); and between two
sizes what lies between, by number of n-grams.
``least`` and ``margin`` are asked at least, and alone of languages with less than ``ENOUGH`` pieces of a size.

Cases: null or empty text has no language, score 0, and is rejected; the whole of a text counts, however long; equal
scores give the language first in order of its name, and are rejected; rows of null language are
not trained on but scored, and ``identified`` puts the language found into ``lang`` of the rows that stay; with one labelled language or none every text is rejected, or has that language; repeated
rows are scored each; further columns pass through ``identified`` and are not read by ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import textnum as tn
from plumbline.llm.common import DOCUMENT_COLUMNS, chunked, column, small, table

PER_LANGUAGE, LANDMARKS, RIDGE = 250, 40, 1e-2
#: Places of the table in which a text's n-grams are told apart.
PLACES = 1 << 18
#: The least share of known n-grams, and the lead of the best score, of a document that is accepted.
LEAST, MARGIN = 0.2, 0.0
#: The part of held-out pieces of a language and size that may lie below a limit, the pieces that a limit takes, and their characters.
HELD, ENOUGH, PIECES = 0.005, 50, tuple(4 << k for k in range(9))
#: Times the share of unknown n-grams, and the part of the lead, that make the limits.
SLACK = 1.2, 0.25
#: Documents that are scored in one product.
BLOCK = 64


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple]:
    """(language, text) of the bounded training sample, in a fixed order."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_language)
    chosen = {r["doc_id"] for r in ids.select("doc_id").collect()}
    if not chosen:
        return []
    few = docs.sparkSession.createDataFrame([(x,) for x in sorted(chosen)], "doc_id bigint")
    rows = docs.where("lang is not null").select("doc_id", "lang", "text").join(F.broadcast(few), "doc_id", "left_semi").where("text is not null and text <> ''")
    return [(lang, text) for _, lang, text in sorted({tuple(r) for r in rows.collect()})]


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Spectrum:
    """The distinct n-grams of texts."""

    def __init__(self):
        self.seen = np.empty(PLACES, np.int32)

    def __call__(self, texts: list) -> Iterator[np.ndarray]:
        points, begins = tn.join(texts)
        one = tn.lowered(points).astype(np.int64) + 1
        two = (one[:-1] << 21) | one[1:]
        three = (two[:-1] << 21) | one[2:]
        places = [((g.view(np.uint64) * _SPREAD) >> np.uint64(46)).astype(np.int32) for g in (one, two, three)]
        for a, b in zip(begins.tolist(), np.append(begins[1:], len(points)).tolist()):
            parts = [slice(a, max(a, b - n)) for n in (1, 2, 3)]
            grams, place = (np.concatenate([x[p] for x, p in zip(xs, parts)]) for xs in ((one, two, three), places))
            order = np.arange(len(grams), dtype=np.int32)
            self.seen[place] = order
            last = self.seen[place]
            mine = grams[last == order]
            # n-grams that another one has taken the place of
            other = grams[grams[last] != grams]
            yield np.concatenate((mine, np.unique(other))) if len(other) else mine


class Known:
    """The places of n-grams among those of the landmarks, which are in order; -1 for others."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.bits = max(8, (8 * len(grams)).bit_length())
        slot = self._slot(grams)
        # of those that share a slot one has it; the others are looked for in order
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[slot] = np.arange(len(grams))
        rest = np.flatnonzero(self.table[slot] != np.arange(len(grams)))
        self.rest, self.crowded = grams[rest], np.zeros(1 << self.bits, bool)
        self.rest_place = rest.astype(np.int32)
        self.crowded[slot[rest]] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        slot = self._slot(grams)
        at = self.table[slot]
        at[(at >= 0) & (self.grams[at] != grams)] = -1
        more = np.flatnonzero((at < 0) & self.crowded[slot])
        if len(more):
            k = np.minimum(np.searchsorted(self.rest, grams[more]), len(self.rest) - 1)
            at[more] = np.where(self.rest[k] == grams[more], self.rest_place[k], -1)
        return at


def limits(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict[str, tuple[np.ndarray, ...]]:
    """Of each language the logarithms of numbers of n-grams, and the least share of known ones and the least lead there."""
    halves: tuple[list, list] = ([], [])
    count: dict[str, int] = {}
    for lang, text in rows:
        halves[count.get(lang, 0) % 2].append((lang, text))
        count[lang] = count.get(lang, 0) + 1
    found: dict[tuple[str, float], list] = {}
    for own, other in (halves, halves[::-1]):
        model = fit(own, landmarks, ridge, held=False)
        if not model or not other:
            continue
        scorer = Scorer(model)
        for size in (*PIECES, None):
            pieces = [(x, t if size is None or len(t) < size else t[(len(t) - size) // 3 :][:size]) for x, t in other if size is None or 2 * len(t) >= size]
            if not pieces:
                continue
            texts = [t for _, t in pieces]
            scores, share, grams = scorer(texts)
            lang, _, lead, _ = verdicts(scores, share, grams, texts, scorer.languages, {}, 0.0, 0.0)
            for (x, _), y, *values in zip(pieces, lang, np.log2(np.maximum(grams, 1)), share, lead):
                if x == y:
                    found.setdefault((x, size or np.inf), []).append(values)
    out: dict[str, list] = {}
    for (lang, _), values in sorted(found.items()):
        if len(values) >= ENOUGH:
            n, share, lead = zip(*values)
            out.setdefault(lang, []).append((np.mean(n), 1 - SLACK[0] * (1 - np.quantile(share, HELD)), SLACK[1] * np.quantile(lead, HELD)))
    return {lang: tuple(np.array(c) for c in zip(*x)) for lang, x in out.items()}


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, held: bool = True) -> dict | None:
    """The model of (language, text) rows, with the limits that held-out pieces of them give; None without any."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    spectrum, texts = Spectrum(), [t for _, t in rows]
    grams = [g for a, b in chunked(texts) for g in spectrum(texts[a:b])]
    of = np.array([languages.index(lang) for lang, _ in rows])
    chosen = np.concatenate([np.flatnonzero(of == k)[:landmarks] for k in range(len(languages))])
    known = np.unique(np.concatenate([grams[k] for k in chosen]))
    place = Known(known)
    matrix = np.zeros((len(known), len(chosen)), np.float32)
    for j, k in enumerate(chosen):
        matrix[place(grams[k]), j] = 1
    model = {"languages": languages, "known": known, "matrix": np.packbits(matrix.astype(bool), axis=0), "norms": 1 / np.sqrt([len(grams[k]) for k in chosen])}
    kernel, _ = _kernel(grams, place, matrix, model["norms"])
    own, vectors = np.linalg.eigh(kernel[chosen])
    keep = own > 1e-6 * own[-1]
    root = vectors[:, keep] / np.sqrt(own[keep])
    features = kernel @ root
    target = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weights = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ target)
    model["weights"] = root @ weights
    model["limits"] = limits(rows, landmarks, ridge) if held else {}
    return model


def _kernel(grams: list[np.ndarray], place: Known, matrix: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kernel values to the landmarks, and the share of each text's n-grams that any of these has."""
    out, share = np.empty((len(grams), matrix.shape[1])), np.empty(len(grams))
    block = np.zeros((BLOCK, matrix.shape[0]), np.float32)
    for a in range(0, len(grams), BLOCK):
        part = grams[a : a + BLOCK]
        block[:] = 0
        for r, g in enumerate(part):
            at = place(g)
            at = at[at >= 0]
            block[r, at] = 1
            share[a + r] = len(at) / max(1, len(g))
        size = np.array([max(1, len(g)) for g in part])
        out[a : a + len(part)] = (block[: len(part)] @ matrix) * norms / np.sqrt(size)[:, None]
    return out, share


class Scorer:
    def __init__(self, model: dict):
        self.languages, self.norms, self.weights, self.limits = model["languages"], model["norms"], model["weights"], model["limits"]
        self.spectrum, self.place = Spectrum(), Known(model["known"])
        self.matrix = np.unpackbits(model["matrix"], axis=0, count=len(model["known"])).astype(np.float32)

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, a row for each text and a column for each language, the shares of known n-grams, and their numbers."""
        parts = []
        for a, b in chunked(texts):
            grams = list(self.spectrum(texts[a:b]))
            parts.append((*_kernel(grams, self.place, self.matrix, self.norms), np.array([len(g) for g in grams])))
        kernel, share, count = (np.concatenate(x) for x in zip(*parts))
        return kernel @ self.weights, share, count


def verdicts(scores: np.ndarray, share: np.ndarray, grams: np.ndarray, texts: list, languages: list[str], held: dict, least: float, margin: float) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    best = scores.argmax(1)
    top = scores[np.arange(len(best)), best]
    rest = scores.copy()
    rest[np.arange(len(best)), best] = -np.inf
    lead = top - rest.max(1) if scores.shape[1] > 1 else np.full(len(best), 2.0)
    lettered = np.array([bool(t) and any(c.isalpha() for c in t) for t in texts], bool)
    top, lead = np.where(lettered, top, 0.0), np.where(lettered, lead, 0.0)
    enough = lettered & (share >= least) & (lead > margin)
    for k, lang in enumerate(languages):
        if lang in held:
            size, shares, leads = held[lang]
            n = np.log2(np.maximum(grams, 1))
            # a hair less, as scores of equal texts may differ in the last digits
            enough &= (best != k) | ((share >= np.interp(n, size, shares) - 1e-9) & (lead >= np.interp(n, size, leads) - 1e-9))
    return [languages[k] if ok else None for k, ok in zip(best, lettered)], top, lead, enough


def _score(docs: DataFrame, keep: list[str], per_language: int, least: float, margin: float) -> DataFrame:
    model = fit(sample(docs, per_language))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(docs.dtypes)
    out = ", ".join(["predicted_lang string, score double, margin double, coverage double, accepted boolean", *(f"`{c}` {types[c]}" for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in small(batches):
            texts = column(batch, "text")
            if scorer and texts:
                scores, share, grams = scorer(texts)
                lang, top, lead, ok = verdicts(scores, share, grams, texts, scorer.languages, scorer.limits, least, margin)
            else:
                share = top = lead = np.zeros(len(texts))
                lang, ok = [None] * len(texts), np.zeros(len(texts), bool)
            rest = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(top), pa.array(lead), pa.array(share), pa.array(ok), *rest], ["predicted_lang", "score", "margin", "coverage", "accepted", *keep])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, out)


def predict(docs: DataFrame, per_language: int = PER_LANGUAGE, least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """For each row of ``docs`` its language, score, lead, share of known n-grams, and whether it is accepted. The training documents are read first; scoring has no shuffle."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return _score(docs, ["doc_id"], per_language, least, margin).select("doc_id", "predicted_lang", "score", "margin", "coverage", "accepted")


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE, least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the columns of documents; ``lang`` is the language found."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    kept = _score(docs, list(DOCUMENT_COLUMNS), per_language, least, margin).where("accepted")
    return kept.withColumn("lang", F.col("predicted_lang")).select(*DOCUMENT_COLUMNS)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
