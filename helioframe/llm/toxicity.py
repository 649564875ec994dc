"""Toxicity classifier with a counterfactual penalty: swapping identity terms must not change a score.

Every labelled text that names a group is paired with its counterfactuals: the text with each identity term replaced by
the next of its kind, and by the kind's neutral word. As few texts name a group, a mention is also planted in one
sentence of each labelled text, from fixed templates; the text with it keeps its label, is a further row to fit on, and
is paired with its counterfactuals too. The logistic loss gets a penalty on the squared difference of the two logits of
each pair, so weight that would rest on a mention itself is pushed to that of the neutral word, and neutral mentions of
a group do not raise the score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from helioframe.llm import features as X

STARTS, BITS, THRESHOLD, EPOCHS, RATE, RIDGE, SWAP_PENALTY, CHOSEN = (4, 5, 6, 7), 20, 0.5, 25, 0.15, 1e-5, 2.0, 300
#: Neutral names of groups, by kind; a swap takes the next one of the kind, or its last, which names no group.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender people", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "local"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "neighbours"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "other"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "single"),
    ("immigrants", "foreigners", "refugees", "citizens", "residents"),
    ("disabled", "deaf", "blind", "elderly", "young", "busy"),
    ("frauen", "männer", "leute"), ("femmes", "hommes", "gens"), ("mujeres", "hombres", "personas"),
    ("musulmans", "chrétiens", "juifs", "voisins"), ("musulmanes", "cristianos", "judíos", "vecinos"), ("christen", "juden", "muslime", "nachbarn"),
)
#: What is planted in a sentence, with a term in place of {}.
TEMPLATES = ("many {} live here", "said the {}", "{} and others", "for {} too")
_GROUPS = [t for kind in IDENTITY for t in kind[:-1]]
_NEXT = {a.encode(): b.encode() for kind in IDENTITY for a, b in zip(kind[:-1], kind[1:-1] + kind[:1])}
_NEUTRAL = {a.encode(): kind[-1].encode() for kind in IDENTITY for a in kind[:-1]}
_TERM = re.compile(rb"(?<![a-z\x80-\xff])(?:" + b"|".join(re.escape(t) for t in sorted(_NEXT, key=len, reverse=True)) + rb")(?![a-z\x80-\xff])")
_SENTENCE = re.compile(rb"[.!?\n]")


def swap(text: bytes, to: dict[bytes, bytes] = _NEXT) -> bytes:
    """The lower-cased text with every identity term replaced by the next one of its kind, or by what `to` says."""
    return _TERM.sub(lambda m: to[m[0]], text.lower())


def plant(text: bytes) -> bytes:
    """The lower-cased text with a mention planted at the end of one of its sentences; the text decides which one and where."""
    low = text.lower()
    pick, ends = zlib.crc32(low), [m.start() for m in _SENTENCE.finditer(low)] or [len(low)]
    mention = TEMPLATES[pick % len(TEMPLATES)].format(_GROUPS[pick // len(TEMPLATES) % len(_GROUPS)]).encode()
    at = ends[zlib.crc32(low, 1) % len(ends)]
    return low[:at] + b" " + mention + b" " + low[at:]


def _words(low: bytes) -> np.ndarray:
    return X.indicators(low, starts_of=STARTS, bits=BITS)


def _features(text: bytes) -> list[np.ndarray]:
    """Features of the text; those that the text with a planted mention has besides; and for each counterfactual of
    either, the features that only the original has, and those that only the counterfactual has."""
    low = text.lower()
    planted = plant(low)
    own, more = _words(low), _words(planted)
    out = [own, np.setdiff1d(more, own, True)]
    for original, known in ((low, own), (planted, more)):
        for to in (_NEXT, _NEUTRAL):
            if (other := swap(original, to)) != original:
                found = _words(other)
                out += [np.setdiff1d(known, found, True), np.setdiff1d(found, known, True)]
    return out


def choose(rows: list[tuple[int, np.ndarray]], dim: int, most: int = CHOSEN) -> np.ndarray:
    """The features that tell the classes apart best: by the log-likelihood ratio of their counts, tied ones by number."""
    count, total = np.zeros((2, dim)), np.zeros(2)
    for y, x in rows:
        count[y][x] += 1
        total[y] += 1
    p = (count.sum(axis=0) + 0.5) / (total.sum() + 1)
    gain = np.zeros(dim)
    for y in (0, 1):
        q = (count[y] + 0.5) / (total[y] + 1)
        gain += count[y] * np.log(q / p) + (total[y] - count[y]) * np.log((1 - q) / (1 - p))
    gain[count.sum(axis=0) < 3] = 0
    best = np.argsort(-gain, kind="stable")[:most]
    return best[gain[best] > 0]


def fit(rows: list[tuple[int, list[np.ndarray]]], dim: int = 1 << BITS, swap_penalty: float = SWAP_PENALTY, seed: int = 5, most: int = CHOSEN) -> tuple[np.ndarray, float]:
    """(weights by feature, offset) of the penalised logistic model over rows of (label, _features), by adaptive gradient
    steps in a fixed order.

    Each row is fitted as it is and with its planted mention. The `most` best features count, and all that differ
    between a text and a counterfactual. The rarer class weighs more in the loss; the offset is then set on the
    unweighted rows. With one class or no rows the weights are 0.
    """
    w, up = np.zeros(dim), sum(y for y, _ in rows)
    if up in (0, len(rows)):
        return w, float(np.log((up + 1) / (len(rows) - up + 1)))
    keep = np.zeros(dim, bool)
    keep[choose([(y, x[0]) for y, x in rows], dim, most)] = True
    for _, x in rows:
        for f in x[2:]:
            keep[f] = True
    own = [(y, [f[keep[f]] for f in x]) for y, x in rows]
    weigh = {1: min(4.0, (len(rows) - up) / up), 0: 1.0}
    offset, seen, seen0, rng = -1.0, np.full(dim, 1e-6), 1e-6, np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(own)):
            y, (f, added, *pairs) = own[i]
            for x in (f, np.concatenate([f, added])) if len(added) else (f,):
                g = weigh[y] * (1 / (1 + np.exp(-np.clip(w[x].sum() + offset, -30, 30))) - y) / (2 if len(added) else 1)
                d = g + RIDGE * w[x]
                seen[x] += d * d
                w[x] -= RATE * d / np.sqrt(seen[x])
                seen0 += g * g
                offset -= RATE * g / np.sqrt(seen0)
            for here, there in zip(pairs[::2], pairs[1::2]):
                gap = 2 * swap_penalty * (w[here].sum() - w[there].sum())
                for at, s in ((here, gap), (there, -gap)):
                    seen[at] += s * s
                    w[at] -= RATE * s / np.sqrt(seen[at])
    margin = np.array([w[x[0]].sum() for _, x in own]) + offset
    a, b = X.logistic(margin, np.array([y for y, _ in own]))
    return a * w, a * offset + b


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text): score is the probability of toxic 1.

    Null texts are scored as empty ones. Repeated rows are scored alike. Of an id with several labels the largest
    counts; labels without an id or a value are left out. Without labels all scores are 0.5. More columns are ignored,
    and an empty table gives an empty result.
    """
    w, offset = fit(X.sample(docs, labels, "toxic", _features))
    w = w.astype(np.float32)

    def run(text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(float(w[_words(text.lower())].sum()) + offset, -30, 30))))

    return X.score(docs, run, threshold)
