"""License scan: winnowed fingerprints find candidates, banded alignment reports coverage and spans.

Texts and templates are cut to words (white space and ASCII punctuation part
them, A-Z count as a-z) and three-word shingles.  Of every ``WINDOW``
neighbouring shingles the one of least hash is a fingerprint, so any common run
of ``WINDOW + SHINGLE - 1`` words shares one; a template of fewer words is
looked up at every shingle.  An inverted index of the templates' fingerprints
gives places in the text; places of one template on
about the same diagonal are aligned with it by local alignment (match 1,
mismatch and gap -1) in a band around them.  The result is the share of the
template's words that matched, and the span from the first to the last of them.

Templates are a short fixed list, a few kilobytes, that travels with the task;
texts are independent, so the scan is one map.

Defined results: one row per place where at least ``min_coverage`` of a
template matched; of overlapping places of one template the one with more
matched words, the first of equals; notices that share wording (GPL, LGPL and
AGPL, say) each give a row, of which the right one has most matched words;
null, empty and blank texts give no row; a text repeated in several rows is
reported for each; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from candlespark.llm.common import Words, runs, shingles, shipped, tables, words
from candlespark.llm.license_texts import TEMPLATES

SHINGLE = 3
WINDOW = 3
BAND = 8
MIN_COVERAGE = 0.6
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SIEVE = 20

REPORT = "doc_id long, license string, coverage double, n_matched long, first_char long, last_char long"


def fingerprints(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the least of every ``WINDOW`` neighbours within a text, the last of equals."""
    out = np.zeros(len(hashes), bool)
    n = np.diff(cut)
    short = np.repeat(n < WINDOW, n)
    out[short] = True  # a text with fewer shingles keeps them all
    if len(hashes) >= WINDOW:
        doc = np.repeat(np.arange(len(n)), n)
        i = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
        least = np.minimum.reduce([hashes[i + k] for k in range(WINDOW)])
        for k in reversed(range(WINDOW)):
            hit = hashes[i + k] == least
            out[i[hit] + k] = True
            i, least = i[~hit], least[~hit]
    return np.flatnonzero(out)


class Templates:
    """The templates' words and the inverted index of their fingerprints."""

    def __init__(self, texts: dict[str, str]):
        self.names = list(texts)
        t = tables(also_apart=PUNCTUATION)
        column = pa.array([texts[n] for n in self.names], pa.string())
        self.words: list[np.ndarray] = []
        entries, short = [], []
        for _, _, data, bounds in runs(column):
            w = words(data, bounds, t)
            hashes, cut = shingles(w, SHINGLE)
            at = fingerprints(hashes, cut)
            doc = np.searchsorted(cut, at, "right") - 1
            entries += list(zip(hashes[at].tolist(), (doc + len(self.words)).tolist(), (at - cut[doc]).tolist(), strict=True))
            short.append(hashes[np.repeat(np.diff(cut) < WINDOW, np.diff(cut))])
            self.words += [w.hash[w.first[k] : w.first[k + 1]] for k in range(len(bounds) - 1)]
        self.short = np.unique(np.concatenate(short)) if short else np.empty(0, np.uint64)  #: no run of WINDOW shingles holds these
        entries.sort()
        self.hashes = np.array([e[0] for e in entries], np.uint64)
        self.template, self.place = np.array([e[1] for e in entries], int), np.array([e[2] for e in entries], int)
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.hashes & np.uint64((1 << SIEVE) - 1)] = True

    def marks(self, hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Places to look up: the fingerprints of each text, and every shingle of a template too short to share one for sure."""
        own = fingerprints(hashes, cut)
        return np.union1d(own, np.flatnonzero(np.isin(hashes, self.short))) if len(self.short) else own

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place in ``hashes`` and an entry of the index with that fingerprint."""
        at = np.flatnonzero(self.sieve[hashes & np.uint64((1 << SIEVE) - 1)])
        low, high = (np.searchsorted(self.hashes, hashes[at], side) for side in ("left", "right"))
        n = high - low
        return np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def aligned(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """Matched words and their first and last place in ``text``, by local alignment on the diagonals ``low`` to ``high``."""
    width = high - low + 1
    score = np.zeros((len(pattern) + 1, width + 2), np.int32)
    slots = np.arange(width)
    equal = np.zeros((len(pattern), width), bool)
    for i, word in enumerate(pattern):
        j = i + low + slots
        inside = (j >= 0) & (j < len(text))
        equal[i, inside] = text[j[inside]] == word
        # Column c of row i is diagonal low + c - 1, so the cell above in the text's direction is one column to the right.
        step = np.where(equal[i], score[i, 1:-1] + 1, score[i, 1:-1] - 1)
        best = np.maximum(np.maximum(step, score[i, 2:] - 1), 0)
        best = np.where(inside, best, 0)
        score[i + 1, 1:-1] = np.maximum.accumulate(best + slots) - slots
    end = int(np.argmax(score))
    i, c = divmod(end, width + 2)
    if score[i, c] <= 0:
        return None
    places = []
    while i > 0 and score[i, c] > 0:
        now = score[i, c]
        hit = equal[i - 1, c - 1]
        if now == score[i - 1, c] + (1 if hit else -1):
            if hit:
                places.append(i - 1 + low + c - 1)
            i -= 1
        elif now == score[i - 1, c + 1] - 1:
            i, c = i - 1, c + 1
        elif c > 1 and now == score[i, c - 1] - 1:
            c -= 1
        else:
            break
    return (len(places), places[-1], places[0]) if places else None


def found(text: np.ndarray, at: np.ndarray, entry: np.ndarray, known: Templates, min_coverage: float) -> list[tuple[int, int, int, int]]:
    """``(template, matched words, first word, last word)`` in one text, from its fingerprint hits."""
    out = []
    which = known.template[entry]
    for k in np.unique(which).tolist():
        places = at[which == k]
        of_place = places - known.place[entry][which == k]
        pattern, diagonals = known.words[k], np.unique(of_place)
        spots = []
        a = 0
        while a < len(diagonals):
            b = int(np.searchsorted(diagonals, diagonals[a] + BAND, "right"))
            # Notices that follow each other closely lie in one band: what was found is blanked and the rest looked at again.
            rest, left = text.copy(), places[np.isin(of_place, diagonals[a:b])]
            while len(left):
                hit = aligned(pattern, rest, int(diagonals[a]) - BAND, int(diagonals[b - 1]) + BAND)
                if not hit or hit[0] < min_coverage * len(pattern):
                    break
                spots.append(hit)
                rest[hit[1] : hit[2] + 1] = 0
                left = left[(left < hit[1]) | (left > hit[2])]
            a = b
        taken: list[tuple[int, int, int]] = []
        for n, first, last in sorted(set(spots), key=lambda s: (-s[0], s[1])):
            if all(last < f or first > z for _, f, z in taken):
                taken.append((n, first, last))
        out += [(k, n, first, last) for n, first, last in sorted(taken, key=lambda s: s[1])]
    return out


def _spans(w: Words, data: np.ndarray, bounds: np.ndarray, k: int, first: int, last: int) -> tuple[int, int]:
    """Code points before the first word and up to the end of the last, in text ``k``."""
    starts = np.cumsum((data[bounds[k] : bounds[k + 1]] & 0xC0) != 0x80)
    a, b = w.start[w.first[k] + first] - bounds[k], w.end[w.first[k] + last] - bounds[k]
    return int(starts[a]) - 1, int(starts[b - 1])


def scan(docs: DataFrame, texts: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """:data:`REPORT` rows of ``docs`` (doc_id, text); ``texts``: templates by name."""
    texts = TEMPLATES if texts is None else texts

    def report(batches):
        known, t = Templates(texts), tables(also_apart=PUNCTUATION)
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for a, _, data, bounds in runs(batch.column("text")):
                w = words(data, bounds, t)
                hashes, cut = shingles(w, SHINGLE)
                mark = known.marks(hashes, cut)
                at, entry = known.hits(hashes[mark])
                at = mark[at]
                edges = np.searchsorted(at, cut)
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    lo, hi = edges[k], edges[k + 1]
                    own = w.hash[w.first[k] : w.first[k + 1]]
                    for name, n, first, last in found(own, at[lo:hi] - cut[k], entry[lo:hi], known, min_coverage):
                        span = _spans(w, data, bounds, k, first, last)
                        out.append((ids[a + k].as_py(), known.names[name], n / len(known.words[name]), n, *span))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "license", "coverage", "n_matched", "first_char", "last_char"]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(report, REPORT)


shipped("candlespark.llm.license_texts")
shipped(__name__)
