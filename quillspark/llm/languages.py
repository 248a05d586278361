"""Problem 5: the language of each record and of each segment of a mixed one, with a confidence.

A character language model of order five per language, with interpolated Kneser-Ney smoothing, is fitted on a bounded
sample of labelled rows; since labels may be wrong, the sample's sentences are labelled again by the model itself and
the models fitted once more. The n-grams of all languages stand in one sorted array of hashes per order, beside a
matrix of their log probabilities, and the back-off weights of the contexts in another, so a text is scored for all
languages at once by binary search over whole batches. A sentence gets the language with the lowest cross-entropy per
character; the probability is calibrated on held-out rows, and short, undecided or alien sentences are rejected.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the fitting sample: rows, and characters of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 4000
ORDER, DISCOUNT, FLOOR = 5, 0.75, 1.0 / 120
#: Words and letters of a sentence, lead over the second language in all and per letter, that a decision takes.
MIN_WORDS, MIN_LETTERS, MIN_LEAD, MIN_RATE = 5, 16, 6.0, 0.15

# Labels that name a language, apart from case, blanks and region.
LABELS = {
    "en": "en eng english", "ms": "ms msa may zsm malay", "fr": "fr fra fre french", "de": "de deu ger german", "es": "es spa spanish",
}
LANGS = tuple(LABELS)
_LABEL = {x: lang for lang, names in LABELS.items() for x in names.split()}
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'»”’)\]]*\s+|\n+")
_NOISE = re.compile(r"\S*[\d_@/\\]\S*|[^\w\s'’-]|_")


def label_of(label: str | None) -> str | None:
    """The language that a label names in any spelling; None if it says nothing or names none of the five."""
    if not label:
        return None
    x = label.strip().lower()
    return _LABEL.get(x) or _LABEL.get(re.split(r"[-_\s]", x)[0])


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def letters_of(text: str) -> str:
    """What the models read of a text: words without figures and marks, in lower case, single blanks around each."""
    words = " ".join(_NOISE.sub(" ", text.lower()).split())
    return f" {words} " if words else ""


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 blanks, and the text that each position belongs to (-1: padding)."""
    pad = " " * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), "u4").astype("u8") if texts else np.zeros(0, "u8")
    of = np.full(len(codes), -1, "i8")
    at = ORDER - 1
    for i, t in enumerate(texts):
        of[at : at + len(t)] = i
        at += len(t) + ORDER - 1
    return codes, of


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each position; the first n - 1 positions are of no use."""
    h = np.full(len(codes), n, "u8")
    for j in range(n - 1, -1, -1):
        h = (h * np.uint64(0x100000001B3)) ^ np.roll(codes, j)
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return at, keys[at] == h


class Models:
    """Interpolated Kneser-Ney models of all languages in sorted hash arrays."""

    def __init__(self, texts: list[str], labels: list[int]) -> None:
        n_langs = len(LANGS)
        self.grams: list = [None] * (ORDER + 1)
        self.contexts: list = [None] * (ORDER + 1)
        labels_of = np.array(labels)
        codes, of = _packed(texts)
        inside = of >= 0
        lang = np.where(inside, labels_of[np.maximum(of, 0)] if len(texts) else 0, -1)
        hashes = [None, *(_hashes(codes, n) for n in range(1, ORDER + 1))]
        with np.errstate(divide="ignore"):
            for n in range(1, ORDER + 1):
                keys = np.unique(hashes[n][inside])
                last = np.zeros(len(keys), "i8")
                at, _ = _find(keys, hashes[n][inside])
                last[at] = np.flatnonzero(inside)  # a place at which the n-gram ends, for its context and its lower order
                counts = np.zeros((len(keys), n_langs))
                if n == ORDER:
                    np.add.at(counts, (at, lang[inside]), 1)
                else:  # how many different characters stand before it
                    for x in range(n_langs):
                        own = inside & (lang == x)
                        longer, first = np.unique(hashes[n + 1][own], return_index=True)
                        if len(longer):
                            np.add.at(counts, (_find(keys, hashes[n][np.flatnonzero(own)[first]])[0], x), 1)
                if n == 1:
                    total = np.maximum(counts.sum(0), 1)
                    kinds = (counts > 0).sum(0)
                    p = np.maximum(counts - DISCOUNT, 0) / total + DISCOUNT * kinds / total * FLOOR
                    self.grams[1] = (keys, np.log(np.maximum(p, FLOOR * 1e-3)).astype("f4"))
                    self.contexts[1] = np.log(np.maximum(DISCOUNT * kinds / total * FLOOR, 1e-6)).astype("f4")
                    continue
                context = np.roll(hashes[n - 1], 1)[last]
                c_keys, c_at = np.unique(context, return_inverse=True)
                total, kinds = np.zeros((len(c_keys), n_langs)), np.zeros((len(c_keys), n_langs))
                np.add.at(total, c_at, counts)
                np.add.at(kinds, c_at, counts > 0)
                seen = total > 0
                gamma = np.where(seen, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                lower = np.exp(self.grams[n - 1][1][_find(self.grams[n - 1][0], hashes[n - 1][last])[0]])
                p = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[c_at] + gamma[c_at] * lower
                self.grams[n] = (keys, np.log(np.maximum(p, 1e-9)).astype("f4"))
                self.contexts[n] = (c_keys, np.log(gamma).astype("f4"))
        self.temperature, self.alien = 1.0, 99.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """(len(texts), languages): the log probability of each prepared text."""
        out = np.zeros((len(texts), len(LANGS)))
        for a in range(0, len(texts), 20_000):
            codes, of = _packed(texts[a : a + 20_000])
            left = np.flatnonzero(of >= 0)
            logs = np.zeros((len(codes), len(LANGS)), "f4")
            for n in range(ORDER, 0, -1):
                if not len(left):
                    break
                h = _hashes(codes, n)[left]
                keys, p = self.grams[n]
                at, there = _find(keys, h)
                logs[left[there]] += p[at[there]]
                left = left[~there]
                if n > 1 and len(left):
                    c_keys, g = self.contexts[n]
                    c_at, known = _find(c_keys, np.roll(_hashes(codes, n - 1), 1)[left])
                    logs[left[known]] += g[c_at[known]]
                elif len(left):
                    logs[left] += self.contexts[1]
            own = of >= 0
            for x in range(len(LANGS)):
                out[a : a + 20_000, x] = np.bincount(of[own], logs[own, x], len(texts[a : a + 20_000]))
        return out

    def decide(self, texts: list[str], alone: bool = False) -> list[tuple[int, float]]:
        """(language or -1, probability) of each prepared text; -1 for short, undecided and alien ones. alone: even two words may do."""
        s = self.scores(texts)
        size = np.array([max(1, len(t)) for t in texts])
        letters = np.array([len(t) - t.count(" ") for t in texts])
        order = np.argsort(-s, axis=1)
        best, second = np.take_along_axis(s, order[:, :2], 1).T if len(s) else (np.zeros(0), np.zeros(0))
        z = (s - s.max(1, keepdims=True)) * self.temperature if len(s) else s
        p = 1 / np.exp(z).sum(1) if len(s) else np.zeros(0)
        lead = best - second
        words = np.array([t.count(" ") - 1 for t in texts])
        if alone:
            sure = (words >= 2) & (lead >= MIN_LEAD / 2)
            return [(int(o) if ok else -1, float(q)) for o, ok, q in zip(order[:, 0], sure, p)]
        sure = (words >= MIN_WORDS) & (letters >= MIN_LETTERS) & (lead >= MIN_LEAD) & (lead >= MIN_RATE * np.minimum(size, 60)) & (-best / size <= self.alien)
        return [(int(o) if ok else -1, float(q)) for o, ok, q in zip(order[:, 0], sure, p)]


def fit(texts: list[str], labels: list[str]) -> Models:
    """Models from texts and their labels, of which some may be wrong or cover only a part of the text."""
    parts, of, held = [], [], []
    for i, (t, lab) in enumerate(zip(texts, labels)):
        for a, b in sentences(t):
            x = letters_of(t[a:b])
            if x:
                parts.append(x)
                of.append(LANGS.index(lab))
                held.append(i % 5 == 0)
    of, held = np.array(of, "i8"), np.array(held, bool)
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(parts))
    models = Models([parts[i] for i in train], of[train].tolist())
    for _ in range(2):
        got = models.scores([parts[i] for i in train]).argmax(1)
        models = Models([parts[i] for i in train], got.tolist())
    test = np.flatnonzero(held)
    if len(test):
        s = models.scores([parts[i] for i in test])
        size = np.array([len(parts[i]) for i in test])
        # the probability is calibrated against the given labels, of which a share is wrong whatever the model says
        wrong = min(0.5, max(0.001, float((s.argmax(1) != of[test]).mean())))
        best = (np.inf, 1.0)
        for t in np.geomspace(0.02, 1.0, 18):
            z = (s - s.max(1, keepdims=True)) * t
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            loss = -np.log((1 - wrong) * p[np.arange(len(test)), of[test]] + wrong / len(LANGS)).mean()
            best = min(best, (loss, float(t)))
        models.temperature = best[1]
        ce = -s.max(1) / size
        models.alien = float(np.quantile(ce, 0.995) + 1.5)
    return models


def fit_sample(records: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_CHARS) -> Models | None:
    """None without any labelled row; else fit on at most rows labelled rows of records (tbl, rec_id, label, content), chosen by a hash, none longer than most."""
    spellings = sorted(_LABEL)
    base = F.element_at(F.split(F.lower(F.trim("label")), r"[-_\s]"), 1)
    labelled = records.where(base.isin(spellings) & F.char_length("content").between(20, most))
    n = records.count()
    share = min(1.0, rows / max(1, n))
    picked = labelled.where(F.pmod(F.xxhash64("tbl", "rec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("rec_id", "label", "content").limit(rows).collect()
    known = sorted((r.rec_id, r.content, lab) for r in picked if (lab := label_of(r.label)))
    if not known:
        return None
    return fit([x[1] for x in known], [x[2] for x in known])


def labelled_records(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """tbl, rec_id, label, content of several tables: {name: (table, key)}; a row stored twice under its key stays twice, and its cases are made one later."""
    out = None
    for name, (df, key) in tables.items():
        one = df.where(F.col(key).isNotNull()).select(F.lit(name).alias("tbl"), F.col(key).cast("long").alias("rec_id"), F.col("language").cast("string").alias("label"), "content")
        out = one if out is None else out.unionByName(one)
    return out


def segments(records: DataFrame) -> DataFrame:
    """tbl, rec_id, label, segment, start, end, lang, confidence: runs of sentences in one language.

    Rejected sentences join the segment around them; a record of such sentences only is judged as a whole, and gives one
    row with null lang if that is undecided too. Null and blank contents give such a row too. Offsets count characters. Without any labelled
    row every lang is null. Keys stored twice give their rows twice.
    """
    models = pickle.dumps(fit_sample(records))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(models)
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            spans = [sentences(t) for t in texts]
            flat = [letters_of(t[a:e]) for t, own in zip(texts, spans) for a, e in own]
            decided = m.decide(flat) if m else [(-1, 0.0)] * len(flat)
            ends = np.cumsum([len(x) for x in spans])
            starts = ends - [len(x) for x in spans]
            blank = [i for i in range(len(texts)) if starts[i] < ends[i] and all(decided[j][0] < 0 for j in range(starts[i], ends[i]))]
            for i, d in zip(blank, m.decide([" ".join(flat[starts[i] : ends[i]]) for i in blank], alone=True) if m else ()):
                decided[starts[i] : ends[i]] = [d] * (ends[i] - starts[i])
            said = iter(decided)
            out: list[tuple] = []
            for i, own in enumerate(spans):
                runs: list[list] = []
                for a, e in own:
                    lang, p = next(said)
                    if runs and (lang < 0 or runs[-1][2] in (lang, -1)):
                        r = runs[-1]
                        r[1] = e
                        if lang >= 0:
                            r[2], r[3], r[4] = lang, r[3] + p * (e - a), r[4] + e - a
                    else:
                        runs.append([a, e, lang, p * (e - a) if lang >= 0 else 0.0, e - a if lang >= 0 else 0])
                for k, (a, e, lang, p, n) in enumerate(runs or [[0, len(texts[i]), -1, 0.0, 0]]):
                    out.append((i, k, a, e, LANGS[lang] if lang >= 0 else None, p / n if n else 0.0))
            row = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(row) for c in range(3)), *(pa.array([x[c] for x in out], y) for c, y in zip(range(1, 6), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())))],
                names=["tbl", "rec_id", "label", "segment", "start", "end", "lang", "confidence"],
            )

    return records.mapInArrow(look, "tbl string, rec_id long, label string, segment int, start int, end int, lang string, confidence double")


def record_languages(found: DataFrame) -> DataFrame:
    """tbl, rec_id, labels, langs, confidence (the least of its languages' best): one row per record."""
    per = found.where("lang is not null").groupBy("tbl", "rec_id", "lang").agg(F.max("confidence").alias("c"), F.max("label").alias("label"))
    return per.groupBy("tbl", "rec_id").agg(F.sort_array(F.collect_set("lang")).alias("langs"), F.min("c").alias("confidence"), F.max("label").alias("label"))


def label_cases(found: DataFrame) -> DataFrame:
    """tbl, rec_id, lang: records whose label is missing, says nothing or names another language, and all mixed records."""
    pairs = sorted(_LABEL.items())
    named = F.create_map(*[F.lit(x) for p in pairs for x in p])
    clean = F.lower(F.trim(F.regexp_replace("label", r"\s+", " ")))
    label = F.coalesce(F.try_element_at(named, clean), F.try_element_at(named, F.try_element_at(F.split(clean, r"[-_\s]"), F.lit(1))))
    r = record_languages(found)
    case = (F.size("langs") > 1) | label.isNull() | (label != F.col("langs")[0])
    return r.where(case).select("tbl", "rec_id", F.explode("langs").alias("lang"))
