"""Language identification: spans of one language by Viterbi over per-word scores.

A word's script (from its code points' Unicode ranges) narrows the languages to
those whose training words use that script; no other is scored for the word, or can
label it.  A word of a script that no language uses scores the same for all.
Narrowed candidates are scored by smoothed, hashed letter n-grams (lengths 1 to 4,
with word edges).  Viterbi with a penalty for each switch then labels every word;
runs of one label are the spans.

A null text, or one without a letter, is ``und`` with score 0 and no spans.
Repeated rows and equal texts get equal results; ties go to the language that
sorts first.  With no training row everything is ``und``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import in_batches, lowest, stored, values

#: (first code point, last code point, script); letters outside are "other".
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x0370, 0x03FF, "greek"), (0x1F00, 0x1FFF, "greek"),
    (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"),
    (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0xAC00, 0xD7AF, "hangul"),
    (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0x20000, 0x2FA1F, "han"),
)
#: The n-gram table has 2^18 rows, or fewer where languages are so many that it would take more than these bytes.
HASH_BITS, MODEL_BYTES = 18, 64 << 20
#: Letters by languages that are scored at once, and those by which texts are dealt to one decoding.
SCORED, DECODED = 1 << 22, 1 << 25
#: What a word adds to a text's evidence for a language that its script rules out.
RULED_OUT = -50.0
LETTER = r"\p{L}"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its script's number (0: no letter or mark, 1: other), its lower case, and whether it is a letter, not a mark."""
    points = np.arange(0x110000, dtype=np.uint32)
    script = np.zeros(0x110000, dtype=np.uint8)
    kind = np.fromiter((ord(unicodedata.category(chr(p))[0]) for p in range(0x110000)), dtype=np.uint8, count=0x110000)
    letter = (kind == ord("L")) | (kind == ord("M"))
    script[letter] = 1
    for lo, hi, name in SCRIPTS:
        part = script[lo : hi + 1]
        part[letter[lo : hi + 1]] = NAMES.index(name)
    lower = points.copy()
    for p in np.flatnonzero(letter):
        low = chr(p).lower()
        if len(low) == 1:
            lower[p] = ord(low)
    return script, lower, kind == ord("L")


NAMES = ["", "other", *dict.fromkeys(s for _, _, s in SCRIPTS)]


@dataclass
class Words:
    """The words of some texts, side by side: bounds in their text, script, and hashes of each letter's n-grams.

    Marks belong to words; ``lettered`` is false for a text that has no letter besides.
    """

    lettered: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    script: np.ndarray
    starts: np.ndarray
    hashes: list[np.ndarray]


def words_of(given: list[str | None], bits: int = HASH_BITS) -> Words:
    script_table, lower, is_letter = _tables()
    encoded = [(t or "").encode("utf-32-le", "surrogatepass") for t in given]
    sizes = np.array([len(e) // 4 for e in encoded], dtype=np.int64)
    points = np.frombuffer(b"\0\0\0\0" + b"\0\0\0\0".join(encoded) + b"\0\0\0\0\0\0\0\0", dtype=np.uint32)
    begins = 1 + np.concatenate([[0], np.cumsum(sizes[:-1] + 1)]) if len(sizes) else np.zeros(0, np.int64)
    script = script_table[points]
    letter = script > 0
    c = np.where(letter, lower[points], 1).astype(np.uint32)
    at = np.flatnonzero(letter)
    starts = np.flatnonzero(~letter[at - 1]) if len(at) else at
    ends = np.flatnonzero(~letter[at + 1]) if len(at) else at
    first, last = at[starts], at[ends] + 1
    doc = np.searchsorted(begins, first, side="right") - 1
    a, b, d, e = c[at - 1], c[at], c[at + 1], c[np.minimum(at + 2, len(c) - 1)]
    one = b * np.uint32(0x9E3779B1)
    two = (a * np.uint32(0x85EBCA77)) ^ (one + np.uint32(0x27D4EB2F))
    three = (two ^ (two >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + d * np.uint32(0x165667B1)
    four = np.where(letter[at + 1], (three ^ (three >> np.uint32(11))) * np.uint32(0x9E3779B1) + e * np.uint32(0x85EBCA6B), (one ^ np.uint32(0x5BD1E995)) * np.uint32(0xCC9E2D51))
    shift = np.uint32(32 - bits)
    hashes = [((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift for h in (one, two, three, four)]
    lettered = np.zeros(len(given), dtype=bool)
    lettered[doc[np.add.reduceat(is_letter[points[at]].astype(np.int64), starts) > 0] if len(starts) else doc] = True
    return Words(lettered, first - begins[doc], last - begins[doc], doc, script[first], starts, hashes)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # n-gram bucket by language
    allowed: np.ndarray  # script by language
    bits: int = HASH_BITS


def train(rows: list[tuple[str, str]], script_share: float = 0.01, model_bytes: int = MODEL_BYTES) -> Model:
    """rows: (language, text).  Smoothed log likelihoods of hashed n-grams, less their mean over the languages."""
    by_language: dict[str, list[str]] = {}
    for lang, text in rows:
        by_language.setdefault(lang, []).append(text)
    languages = tuple(sorted(by_language))
    bits = min(HASH_BITS, max(8, int(np.log2(model_bytes / 4 / max(1, len(languages))))))
    counts = np.zeros((len(languages), 1 << bits), dtype=np.float32)
    scripts = np.zeros((len(NAMES), len(languages)))
    for k, lang in enumerate(languages):
        mine = by_language[lang]
        for i in range(0, len(mine), 200):
            w = words_of(mine[i : i + 200], bits)
            for h in w.hashes:
                counts[k] += np.bincount(h, minlength=1 << bits)
            scripts[:, k] += np.bincount(w.script, minlength=len(NAMES))
    seen = counts.sum(0) >= 2
    sums = counts.sum(1, keepdims=True, dtype=np.float64) + 0.5 * seen.sum() + 1
    weights = np.zeros((1 << bits, len(languages)), dtype=np.float32)
    for at in range(0, 1 << bits, 1 << 12):
        part = slice(at, at + (1 << 12))
        logs = np.log((counts[:, part] + 0.5) / sums)
        weights[part] = np.where(seen[part], logs - logs.mean(0), 0).T if languages else logs.T
    allowed = scripts >= np.maximum(script_share * scripts.sum(0), 1)
    return Model(languages, weights, allowed, bits)


def fit(docs: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 1500, max_text_bytes: int = 65536, sample_bytes: int = 64 << 20) -> Model:
    """Learns from at most ``sample_rows`` keys of each language, those that hash lowest, and of these from what fits in its share of ``sample_bytes``.

    ``max_text_bytes`` bounds one training text.  Longer texts train nothing, but in a
    language that has no shorter one, of which parts from the first letter on are taken.
    Of rows with one key and language one trains.  Every language with a letter in a text is
    learned, by at least one row.  ``sample_bytes`` and ``sample_rows`` are all that
    bounds what reaches the driver; the scans are as many with 600 languages as with two.
    """
    usable = docs.where(learn_from & F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike(LETTER))
    short = F.octet_length(text) <= max_text_bytes
    size = F.least(F.octet_length(text), F.lit(max_text_bytes))
    given = usable.select(F.col(key).alias("key"), F.col(lang).alias("lang"), short.alias("short"), size.alias("size"), F.xxhash64(text).alias("th"))
    kinds = stored(given.groupBy("lang").agg(F.max("short").alias("short")), "languages")
    chosen = lowest(given.join(kinds, ["lang", "short"]), "lang", "key", sample_rows)
    one = chosen.groupBy("lang", "key").agg(F.min(F.struct("th", "size")).alias("row")).select("lang", "key", "row.*")
    share = sample_bytes / max(1, kinds.count())
    before = F.sum("size").over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, -1))
    ids = stored(one.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= share)).select("lang", "key", "th"), "language-sample")
    begun = F.when(short, F.col(text)).otherwise(F.substring(F.col(text), F.regexp_instr(F.col(text), F.lit(LETTER)), F.lit(max_text_bytes // 4)))  # a character has four bytes at most
    rows = usable.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(text).alias("th"), begun.alias("text")).join(ids, ["key", "lang", "th"])
    return train([(r.lang, r.text) for r in rows.groupBy("lang", "key").agg(F.first("text").alias("text")).collect()])


class Labeller:
    def __init__(self, model: Model, switch_penalty: float = 12.0, scale: float = 0.5):
        self.model, self.penalty, self.scale = model, switch_penalty, scale
        self.narrowed: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _candidates(self, script: int) -> tuple[np.ndarray, np.ndarray]:
        """The languages that use a script, and their n-gram weights."""
        if script not in self.narrowed:
            mine = np.flatnonzero(self.model.allowed[script])
            every = len(mine) == len(self.model.languages)
            self.narrowed[script] = mine, self.model.weights if every else np.ascontiguousarray(self.model.weights[:, mine])
        return self.narrowed[script]

    def word_scores(self, words: Words) -> np.ndarray:
        """Word by language: minus infinity where the script rules a language out, zero for all where it rules all out."""
        n = len(self.model.languages)
        table = np.full((len(words.starts), n), -np.inf)
        sizes = np.diff(np.append(words.starts, len(words.hashes[0])))
        for script in np.unique(words.script).tolist():
            which = np.flatnonzero(words.script == script)
            mine, weights = self._candidates(script)
            if not len(mine):
                table[which] = 0.0
                continue
            bounds = np.cumsum(sizes[which])
            at = 0
            while at < len(which):
                end = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + SCORED // len(mine), side="right")))
                some = which[at:end]
                long = sizes[some]
                first = np.cumsum(long) - long
                letter = np.repeat(words.starts[some] - first, long) + np.arange(int(long.sum()))
                scores = weights[words.hashes[0][letter]]
                for h in words.hashes[1:]:
                    scores += weights[h[letter]]
                table[some[:, None], mine] = np.add.reduceat(scores, first, axis=0) * self.scale
                at = end
        return table

    def label(self, given: list[str | None], spans: bool = True) -> tuple[list[str], list[float], list[list[dict]]]:
        """For each text: its language, the score, and (if asked for) spans (start, end, lang) over code points."""
        out: tuple[list[str], list[float], list[list[dict]]] = ([], [], [])
        most, at = DECODED // max(1, len(self.model.languages)), 0
        while at < len(given):
            end, size = at + 1, len(given[at] or "")
            while end < len(given) and size + len(given[end] or "") <= most:
                size += len(given[end] or "")
                end += 1
            for whole, part in zip(out, self._label(given[at:end], spans)):
                whole += part
            at = end
        return out

    def _label(self, given: list[str | None], spans: bool) -> tuple[list[str], list[float], list[list[dict]]]:
        n, size = len(self.model.languages), len(given)
        langs, scores, found = ["und"] * size, [0.0] * size, [[] for _ in range(size)]
        words = words_of(given, self.model.bits) if n else None
        if words is None or not len(words.starts):
            return langs, scores, found
        table = self.word_scores(words)
        path = self._viterbi(table, words.doc)
        has, begin = np.unique(words.doc, return_index=True)
        letters = np.bincount(words.doc * n + path, weights=words.last - words.first, minlength=size * n).reshape(size, n)[has]
        evidence = np.add.reduceat(np.maximum(table, RULED_OUT), begin, axis=0)
        evidence = np.exp(np.clip(evidence - evidence.max(1, keepdims=True), -50, 0))
        best = letters.argmax(1)
        row = np.arange(len(has))
        score = letters[row, best] / letters.sum(1) * np.maximum(1 / n, evidence[row, best] / evidence.sum(1))
        for d, b, x in zip(has.tolist(), best.tolist(), score.tolist()):
            if words.lettered[d]:
                langs[d], scores[d] = self.model.languages[b], x
        if spans:
            new = np.flatnonzero(np.concatenate([[True], (np.diff(path) != 0) | (np.diff(words.doc) != 0)]))
            last = np.concatenate([new[1:], [len(path)]]) - 1
            for d, a, b, k in zip(words.doc[new].tolist(), words.first[new].tolist(), words.last[last].tolist(), path[new].tolist()):
                if not words.lettered[d]:
                    continue
                found[d].append({"start": a, "end": b, "lang": self.model.languages[k]})
        return langs, scores, found

    def _viterbi(self, table: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The label of each word.  All texts step together, one word a step, the longest first."""
        has, begin, sizes = np.unique(doc, return_index=True, return_counts=True)
        rank = np.empty(len(has), dtype=np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(len(has))
        place = np.searchsorted(has, doc)
        step = np.arange(len(doc)) - begin[place]
        order = np.argsort(step * len(has) + rank[place], kind="stable")  # words by step, then by length of text
        live = np.bincount(step).tolist()
        emitted = table[order]
        source = np.empty(emitted.shape, dtype=np.int16)
        stay = np.arange(emitted.shape[1], dtype=np.int16)
        row = np.arange(len(has))
        value, at = emitted[: live[0]].copy(), live[0]
        for m in live[1:]:
            v = value[:m]
            top = v.argmax(1)
            jump = (v[row[:m], top] - self.penalty)[:, None]
            np.copyto(source[at : at + m], np.where(v < jump, top[:, None], stay), casting="unsafe")
            np.maximum(v, jump, out=v)
            v += emitted[at : at + m]
            at += m
        state = value.argmax(1)
        path = np.empty(len(doc), dtype=np.int64)
        at = len(doc)
        for m in reversed(live):
            at -= m
            path[at : at + m] = state[:m]
            if at:
                state[:m] = source[at : at + m][row[:m], state[:m]]
        out = np.empty_like(path)
        out[order] = path
        return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def with_languages(docs: DataFrame, model: Model, text: str = "text", switch_penalty: float = 12.0, keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and (if ``spans``) ``spans`` to the ``keep`` columns."""
    new = ["lang_pred", "score", "spans"][: 3 if spans else 2]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of the bounded sample
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)][: len(kept) + len(new)])

    def make():
        labeller = Labeller(shared.value, switch_penalty)

        def each(batch):
            found = labeller.label(values(batch, text), spans)
            yield {c: batch.column(batch.schema.get_field_index(c)) for c in kept} | dict(zip(new, found))

        return each

    return in_batches(docs.select(*dict.fromkeys([*kept, text])), schema, make)
