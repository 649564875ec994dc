"""Quality rules in DataFrame functions only: base rules, then a hashed n-gram log-likelihood ratio with a fixed threshold.

The ratio compares a multinomial over hashed n-grams of trusted documents with one of the raw corpus. Tokens are runs
of letters and runs of other characters, so that marks stuck to words are tokens of their own. Unigrams and bigrams
are hashed to BUCKETS; a document's score is the mean over its n-grams of log p_target - log p_raw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import apart, drop, settled, stage, words

BUCKETS = 8192
#: Up to so many trusted ids (16 bytes each) are broadcast; beyond, they are joined.
BROADCAST_ROWS = 2_000_000
#: Documents score at least this to be kept. Of those with 50 words and more, labelled good ones scored -0.02 and more,
#: labelled bad ones -0.70 and less, on sf0.1 and on 0.1 GB alike; the threshold lies between, nearer to the good.
THRESHOLD = -0.25
P = "__rules_"


def _n(name: str) -> Column:
    return F.col(P + name)


def _buckets(text: Column) -> tuple[Column, Column]:
    """Hashes of a text's tokens, and from them (as column `h`) the buckets of its unigrams and bigrams."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{L}+|[^\p{L}\x20\x09-\x0D]+"), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    h = _n("h")
    pairs = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)))
    return hashes, F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS))), pairs)


def fit(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log p_target - log p_raw of each bucket, both with one added to every count.

    docs (doc_id, text) is the raw corpus, counted whole; trusted (doc_id) names the target documents, counted whole
    too. Without any, all ratios are 0 and the threshold keeps everything.
    """
    some = stage(trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias(P + "id")).distinct().withColumn(P + "is", F.lit(1)), "trusted")
    few = some.count() <= BROADCAST_ROWS
    hashes, buckets = _buckets(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias(P + "doc"), "text").join(F.broadcast(some) if few else some, F.col(P + "doc") == F.col(P + "id"), "left")
    rows = rows.select(_n("is"), hashes.alias(P + "h")).select(_n("is"), F.explode(buckets).alias("b"))
    counts = rows.groupBy("b").agg(F.count("*").alias("raw"), F.count(P + "is").alias("target")).collect()  # BUCKETS rows at most
    drop(some)
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for b, r, t in counts:
        raw[b], target[b] = raw[b] + r, target[b] + t
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for r, t in zip(raw, target)]


def measure(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with the rules' columns, each named with the prefix P; columns of docs that start with it are left out.

    Null texts have no words and fail the base rule. Lines are cut at \\n only. A repeated 3-word window is found by
    sorting the windows' 64-bit hashes with their places inside the row; covered words are counted between neighbours.
    """
    docs = docs.select([c for c in docs.columns if not c.lower().startswith(P)])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes, buckets = _buckets(F.col("text").cast("string"))
    out = docs.withColumns({P + "w": words(text), P + "h": hashes})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        P + "n_words": F.size(_n("w")).cast("long"),
        P + "word_chars": F.length(F.array_join(_n("w"), "")).cast("long"),
        P + "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        P + "lines": lines,
        P + "wh": F.transform(_n("w"), lambda x: F.xxhash64(x)),
        P + "b": buckets,
    }).drop(P + "w", P + "h")
    wh = _n("wh")
    windows = F.transform(F.slice(wh, 1, F.greatest(F.size(wh) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(wh, i + 1), F.get(wh, i + 2)))
    table = F.from_json(F.lit(str(ratios)), "array<double>")
    total = F.aggregate(_n("b"), F.lit(0.0), lambda s, x: s + F.get(table, x.cast("int")))
    out = out.withColumns({
        P + "n_dup_lines": (F.size(_n("lines")) - F.size(F.array_distinct(_n("lines")))).cast("long"),
        P + "g": windows,
        P + "score": F.when(F.size(_n("b")) == 0, 0.0).otherwise(total / F.size(_n("b"))),
    }).drop(P + "lines", P + "wh", P + "b")
    out = out.withColumn(P + "s", F.when(F.size(F.array_distinct(_n("g"))) < F.size(_n("g")), F.array_sort(F.transform(_n("g"), lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop(P + "g")
    s = _n("s")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    out = out.withColumn(P + "at", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop(P + "s")
    at = _n("at")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn(P + "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(P + "at")
    failed = (_n("n_words") < 50) | (100 * _n("n_repeat_words") > 50 * _n("n_words"))
    return settled(out.withColumn(P + "base_failed", failed).withColumn(P + "kept", ~_n("base_failed") & (_n("score") >= threshold)))


def trusted_of(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of every row; the score to six places."""
    docs = docs.select("doc_id", "text")
    found = measure(docs, fit(docs, trusted_of(labels)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select("doc_id", *[_n(x).alias(x) for x in names], (F.round(_n("score"), 6) + 0.0).alias("score"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns. Repeated rows are judged alike; null texts go."""
    own, back = apart(docs, P)
    return back(measure(own, fit(docs, trusted_of(labels))).where(_n("kept")))
