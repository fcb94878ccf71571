"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all labelled texts; the counts become one log-probability matrix of fixed size, broadcast to the
executors, where numpy scores whole texts in batches: the n-grams of a batch are hashed at once, their rows of the matrix gathered and
summed per text. The bounds of what fits a language come from all pieces of all labelled texts, in a second pass.

Scale: both passes are maps whose tasks give counts of fixed size a language, summed by key; scoring is one map over the table, without a
shuffle."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix64, only, slices, texts_of, widened

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Buckets whose counts travel in one row; languages whose counts a task holds before it gives them out.
BLOCK, HELD = 1 << 11, 64
#: n-grams that a text's evidence counts as at most in its score, so that this stays a confidence, however long the text. The prediction
#: itself comes from the plain sum over all n-grams and the prior.
EVIDENCE = 40.0
UNKNOWN = "und"
#: Steps of a nat that pieces' evidence is told in; parts of a nat that it is summed in.
STEPS, FIXED = 1 << 8, 1 << 20
#: Code points of the pieces that bounds are fitted for; between them bounds are interpolated, beyond them they stay.
PIECES = (2, 4, 8, 16, 32, 64, 128, 256, 512)
#: How many times as far below the median as the lowest hundredth of pieces a text's evidence may be.
REACH = 2.5
#: The bound is at least this far below the median (nats an n-gram), however alike the labelled texts are.
MARGIN = 1.5
_FACTOR = np.uint64(0x100000001B3)
_LETTER = regex.compile(r"\p{L}")
_DIGITS = regex.compile(r"[^\s\p{N}]*+\p{N}\S*+")
_BLANKS = regex.compile(r"\s+")


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: log-probabilities, one row per hash bucket, one column per language
    weights: np.ndarray
    prior: np.ndarray
    #: least log-probability an n-gram of texts of the language, one row per language, one column per length of ``PIECES``; none: all fit
    bounds: np.ndarray | None = None


def _grams(texts: list[str], orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order, the hash buckets of the n-grams of all texts, one text after another, and where each text's begin; lengths.

    Texts are lower-cased and stand between blanks, so every text of n characters has n + 2 of them."""
    joined = [f" {x.lower()} " for x in texts]
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out, begins = [], []
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, max(orders) + 1):
        key = key[: len(codes) - n + 1] * _FACTOR + codes[n - 1 :] + np.uint64(1)
        if n not in orders:
            continue
        inside = np.ones(len(key), bool)
        for k in range(1, n):  # those that cross into the next text
            inside[ends[:-1] - k] = False
        hashed = (mix64(key) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32)
        counts = np.maximum(lengths - n + 1, 0)
        out.append(hashed[inside])
        begins.append(np.cumsum(counts) - counts)
    return out, begins, lengths


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for whole in batches:
        for batch in slices(whole, "text", most_bytes=1 << 19):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for hashed in _grams(texts)[0]:
                    own += np.bincount(hashed, minlength=BUCKETS)
                rows[lang] = rows.get(lang, 0) + len(texts)
                if len(total) >= HELD:
                    yield from _blocks(total, rows)
                    total, rows = {}, {}
    yield from _blocks(total, rows)


def _blocks(total: dict[str, np.ndarray], rows: dict[str, int]) -> Iterator[dict]:
    """Each language's counts, in blocks of buckets; its rows are told with the first."""
    for lang, counts in total.items():
        for block, x in enumerate(counts.reshape(-1, BLOCK)):
            yield {"lang": [lang], "block": [block], "rows": [0 if block else rows[lang]], "counts": [x.tobytes()]}


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    total: dict[tuple[str, int], np.ndarray] = {}
    rows: dict[tuple[str, int], int] = {}
    for batch in batches:
        for lang, block, n, counts in zip(*(batch.column(x).to_pylist() for x in ("lang", "block", "rows", "counts")), strict=True):
            key = lang, block
            total[key] = total.get(key, 0) + np.frombuffer(counts, np.int64)
            rows[key] = rows.get(key, 0) + n
    for (lang, block), x in total.items():
        yield {"lang": [lang], "block": [block], "rows": [rows[lang, block]], "counts": [x.tobytes()]}


def train(labelled: DataFrame, per_language: int | None = None, smoothing: float = 0.05, bounded: bool = True) -> LanguageModel:
    """Fit on all (text, lang) rows, or with ``per_language`` on about so many of each language, those with small hashes of their id and
    text. Rows without text or lang teach nothing; with no row left, every prediction is unknown. ``bounded``: with the bounds that
    ``identify`` needs for its column ``fit``."""
    rows = only(labelled, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    if per_language is not None:
        share = F.lit(0.0)
        for x in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect():
            share = F.when(F.col("lang") == x["lang"], F.lit(min(1.0, per_language / x["n"]))).otherwise(share)
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30))
    rows = rows.select("text", "lang")
    schema = "lang string, block int, rows long, counts binary"
    counted = arrow_map(arrow_map(rows, _counts, schema).repartition("lang", "block"), _summed, schema).collect()
    langs = tuple(sorted({x["lang"] for x in counted}))
    if not langs:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    counts = np.zeros((BUCKETS, len(langs)))
    seen = np.zeros(len(langs))
    for x in counted:
        counts[x["block"] * BLOCK : (x["block"] + 1) * BLOCK, langs.index(x["lang"])] += np.frombuffer(x["counts"], np.int64)
        seen[langs.index(x["lang"])] += x["rows"]
    weights = np.log(counts + smoothing) - np.log((counts + smoothing).sum(axis=0))
    model = LanguageModel(langs, weights.astype(np.float32), np.log((seen + 1) / (seen + 1).sum()))
    return replace(model, bounds=_bounds(rows, model)) if bounded else model


def _bounds(rows: DataFrame, model: LanguageModel) -> np.ndarray:
    """The bounds of each language's evidence, from all pieces of all its texts that begin with a word and hold a letter.

    Pieces are counted by their evidence in whole steps, in integers, so that the quantiles don't depend on how rows are dealt."""
    shared = rows.sparkSession.sparkContext.broadcast((model.languages, _fixed(model)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        languages, fixed = shared.value
        number = {x: k for k, x in enumerate(languages)}
        held: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text", most_bytes=1 << 18):
                which = np.array([number[x] for x in batch.column("lang").to_pylist()])
                for j, (k, steps) in enumerate(_evidence(fixed, [_worded(x) for x in texts_of(batch)], which)):
                    for lang in set(which.tolist()):
                        n = np.bincount(steps[k == lang])
                        one = held.get((lang, j))
                        if one is not None and len(one) >= len(n):
                            one[: len(n)] += n
                        else:
                            held[lang, j] = n if one is None else n + np.pad(one, (0, len(n) - len(one)))
                if len(held) >= HELD * len(PIECES):
                    yield from told(held)
                    held = {}
        yield from told(held)

    def told(held: dict[tuple[int, int], np.ndarray]) -> Iterator[dict]:
        for (lang, j), n in held.items():
            some = np.flatnonzero(n)
            yield {"lang": np.full(len(some), lang), "piece": np.full(len(some), j), "steps": some, "n": n[some]}

    told_by = arrow_map(rows, run, "lang int, piece int, steps int, n long").groupBy("lang", "piece", "steps").agg(F.sum("n").alias("n"))
    quantiles = told_by.groupBy("lang", "piece").agg(F.percentile("steps", [0.5, 0.99], F.col("n")).alias("at")).collect()
    out = np.full((len(model.languages), len(PIECES)), np.nan)
    for x in quantiles:
        middle, low = -np.array(x["at"]) / STEPS
        out[x["lang"], x["piece"]] = middle - max(MARGIN, REACH * (middle - low))
    for j in range(len(PIECES)):
        none = np.isnan(out[:, j])
        out[none, j] = out[none, j - 1] if j else -np.inf
    return out


def _fixed(model: LanguageModel) -> np.ndarray:
    """The weights as integers, one language after another."""
    return np.rint(model.weights.T * FIXED).astype(np.int64).ravel()


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)


def _evidence(fixed: np.ndarray, texts: list[str], which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of ``PIECES``, all pieces of it in the texts that begin with a word and hold a letter: the number of the text's
    language and minus the mean log-probability there of the n-grams of the piece between blanks, in steps.

    A piece's sum is a difference of running sums; only the two n-grams that end with the blank after it are its own."""
    joined = [f" {x.lower()} " for x in texts]
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    one = codes.astype(np.uint64) + np.uint64(1)
    last = np.repeat(np.cumsum(lengths) - 1, lengths)  # where the blank after each text stands
    lang = np.repeat(which, lengths)
    base = lang * BUCKETS

    def weight(key: np.ndarray, base: np.ndarray) -> np.ndarray:
        return fixed[base + (mix64(key) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)]

    def sums(key: np.ndarray) -> np.ndarray:
        """At i: of all n-grams that begin before i. Those that cross into the next text are in no difference within a text."""
        return np.concatenate([[0], np.cumsum(weight(key, base[: len(key)])), np.zeros(len(codes) - len(key), np.int64)])

    two = one[:-1] * _FACTOR + one[1:]
    c1, c2, c3 = sums(one), sums(two), sums(two[:-1] * _FACTOR + one[2:])
    blank = np.uint64(ord(" ") + 1)
    at_end = weight(one * _FACTOR + blank, base)
    at_end[1:] += weight(two * _FACTOR + blank, base[1:])
    to = c1[:-1].copy()  # at i: sum up to the end of a piece that ends before i
    to[1:] += c2[:-2] + at_end[:-1]
    to[2:] += c3[:-3]
    begins = np.flatnonzero((codes[:-1] == ord(" ")) & (codes[1:] != ord(" "))) + 1
    of = c1[begins] + c2[begins - 1] + c3[begins - 1] - 2 * weight(np.full(len(begins), blank), base[begins])
    letters = np.concatenate([[0], np.cumsum(_letters()[codes])])
    for size in PIECES:
        own = np.flatnonzero(begins + size <= last[begins])
        own = own[letters[begins[own] + size] > letters[begins[own]]]
        total = to[begins[own] + size] - of[own]
        yield lang[begins[own]], -total * STEPS // ((3 * size + 3) * FIXED)


def _worded(text: str) -> str:
    """The text without what holds digits (numbers, keys, hashes), which is of no language; where no letter is left, the whole text."""
    left = _BLANKS.sub(" ", _DIGITS.sub(" ", text)).strip()
    return left if _LETTER.search(left) else text


def _totals(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log-probability of every text (all non-empty) in each language, how many n-grams it has, and its code points."""
    grams, begins, lengths = _grams(texts)
    total = np.zeros((len(texts), len(model.languages)))
    for hashed, begin in zip(grams, begins, strict=True):
        has = np.flatnonzero(np.diff(np.append(begin, len(hashed))))
        if len(has):
            total[has] += np.add.reduceat(model.weights[hashed], begin[has], axis=0, dtype=np.float64)
    return total, np.maximum(3 * lengths - 3, 1), lengths - 2


def score_texts(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number (ties: the first) and its posterior by EVIDENCE n-grams at most, of every text (all non-empty)."""
    total, n, _ = _totals(model, texts)
    best = (total + model.prior).argmax(axis=1)
    total = total * np.minimum(1.0, EVIDENCE / n)[:, None] + model.prior
    total -= total.max(axis=1, keepdims=True)
    posterior = np.exp(total)
    return best, posterior[np.arange(len(best)), best] / posterior.sum(axis=1)


def fitting(model: LanguageModel, texts: list[str], best: np.ndarray) -> np.ndarray:
    """Whether each text (all with letters) is likely enough, an n-gram, in the language of that number."""
    if model.bounds is None:
        return np.ones(len(texts), bool)
    total, n, lengths = _totals(model, [_worded(x) for x in texts])
    evidence = total[np.arange(len(texts)), best] / n
    x = np.log2(np.maximum(lengths, 1))
    fits = np.ones(len(texts), bool)
    for k in set(best.tolist()):
        own = best == k
        fits[own] = evidence[own] >= np.interp(x[own], np.log2(PIECES), model.bounds[k])
    return fits


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score", fit: str | None = None) -> DataFrame:
    """``docs`` with the predicted language of each whole text and its confidence (0 to 1).

    Null texts and texts without a letter are ``und``, with score 0, as all are by a model that has learned nothing; of equally likely
    languages the first by name is given. Nothing but the text is looked at. Repeated rows each keep theirs; an empty table stays empty;
    other columns stay, those of the new names are replaced. ``fit`` names a further column: whether the text is as likely in that
    language as its labelled texts are, so that it's of no unlearned language."""
    docs, schema = widened(docs, f"`{out}` string, `{score}` double" + (f", `{fit}` boolean" if fit else ""))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, text, most_bytes=1 << 19):
                texts = texts_of(batch, text)
                which = [i for i, x in enumerate(texts) if model.languages and _LETTER.search(x)]
                langs, scores, fits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if which:
                    own = [texts[i] for i in which]
                    best, sure = score_texts(model, own)
                    if fit:
                        fits[which] = fitting(model, own, best)
                    scores[which] = np.clip(sure, 0.0, 1.0)
                    for i, b in zip(which, best.tolist(), strict=True):
                        langs[i] = model.languages[b]
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                yield columns | {out: langs, score: scores} | ({fit: fits} if fit else {})

    return arrow_map(docs, run, schema)
