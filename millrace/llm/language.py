"""Languages of texts, of their passages and of whole documents, against their labels (problem 4).

Method: string-kernel classification. Two texts are compared by the blended-spectrum presence kernel:
the share of character n-grams (1 to ``ORDERS``, hashed into ``FEATURES``) that both contain, each counted once, normalised by
both sizes. Kernel ridge regression, one against the rest, is fitted on Nystroem features of
``LANDMARKS`` labelled samples. The kernel is linear in the presence vector, so landmarks and weights
fold into one matrix of n-gram weights, and a batch of passages is scored by the product of its sparse
presence matrix with that matrix (gathered rows, added by passage).

Passages are sentences and lines; a passage with too few letters takes the language of its neighbour.
A text's language is that of most letters; a language stands in a mixed text if a run of its passages
has at least ``PASSAGE_LETTERS`` letters and a clear score.

The labelled samples are fetched up to ``MAX_SAMPLES`` rows (documented bound); everything else covers
all rows: the texts are read once, map-only; what is shuffled after are five counts a chunk.

Defined cases: a text without letters has no language and gives no row, whatever its label; rows repeated
under one id count once, with the text and label of the latest; null ids are left out; documents without
chunks give no row; without samples the call fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.runtime import checkpoint, spread

ORDERS = 3
#: Bits of an n-gram's hash: n-grams that share a feature count as one, which is where this differs from the exact kernel.
FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
LANDMARKS = 120
RIDGE = 0.05
MAX_SAMPLES = 20_000
#: Letters below which a passage is not scored on its own, and those a passage of another language must have.
SHORT_LETTERS = 14
PASSAGE_LETTERS = 24
#: The same for a passage that no closing mark ends (a heading is none, a long list may be one).
UNCLOSED_LETTERS = 90
#: Score margin of such a passage, and the confidence a chunk needs to contradict its label.
CLEAR = 0.35
DOUBT = 0.08
#: Code points of a batch that are handled at once.
BLOCK = 400_000

# Codes and names of languages (ISO 639-1, frequent codes of ISO 639-2, names).
CODES = "aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
NAMES = {
    "en": "eng english anglais englisch inglés ingles الإنجليزية", "fr": "fra fre french français francais französisch francés frances الفرنسية",
    "es": "spa spanish español espanol spanisch espagnol castellano الإسبانية", "de": "deu ger german deutsch allemand alemán aleman الألمانية",
    "ar": "ara arabic arabe árabe arabisch العربية عربي", "pt": "por portuguese português", "it": "ita italian italiano", "nl": "nld dut dutch nederlands",
    "ru": "rus russian", "zh": "zho chi chinese", "ja": "jpn japanese", "tr": "tur turkish", "pl": "pol polish", "fa": "fas per persian farsi", "hi": "hin hindi", "ko": "kor korean", "sv": "swe swedish", "da": "dan danish", "fi": "fin finnish", "el": "ell gre greek", "he": "heb hebrew", "cs": "ces cze czech", "ro": "ron rum romanian", "uk": "ukr ukrainian", "ca": "cat catalan",
}


def label_language(label: Column) -> Column:
    """Two-letter code of what a label names, null if it names no language; region and case make no difference."""
    known = {c: c for c in CODES.split()} | {n: c for c, names in NAMES.items() for n in names.split()}
    base = F.lower(F.regexp_extract(F.trim(label), r"^([^\W\d_]+)(?:$|[-_ .@(])", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), base)


_alpha: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _alpha:
        _alpha.append(np.array([chr(i).isalpha() for i in range(0x3000)]))
    return _alpha[0][np.minimum(codes, 0x2FFF)] | (codes >= 0x3000) & (codes < 0xFFFF)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts (non-letters as 0), passage of each point; of each passage its text, its start there, and whether a sentence ends it.

    A passage ends at a line end, or at closing punctuation that white space follows.
    """
    low = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t in low])
    letter = _letters(codes)
    space = (codes == 32) | (codes == 9) | (codes == 0xA0)
    closing = (codes == 46) | (codes == 33) | (codes == 63) | (codes == 0x61F) | (codes == 0x3002) | (codes == 58)
    cut = (codes == 10) | (codes == 13)
    cut[:-1] |= closing[:-1] & (space[1:] | cut[1:])
    passage = np.concatenate(([0], np.cumsum(cut)[:-1]))
    first = np.concatenate(([0], np.flatnonzero(cut)[:-1] + 1))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    text = np.searchsorted(starts, first, "right") - 1
    last = np.flatnonzero(cut)
    ends = closing[last] & (codes[last] != 58)
    return np.where(letter, codes, 0), passage, text, first - starts[text], ends


def presence(codes: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse presence matrix: sorted passage numbers and n-gram features, each pair once."""
    c = codes.astype(np.uint64)
    h = np.zeros(len(c), np.uint64)
    keys = []
    for n in range(1, ORDERS + 1):
        size = len(c) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
        whole = (passage[:size] == passage[n - 1 :]) & ((c[:size] != 0) | (c[n - 1 :] != 0))
        feature = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)
        keys.append((passage[:size].astype(np.int64) << FEATURE_BITS | feature.astype(np.int64))[whole])
    k = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    k = k[np.concatenate(([True], k[1:] != k[:-1]))] if len(k) else k
    return k >> FEATURE_BITS, k & (FEATURES - 1)


class Classifier:
    """Languages and the n-gram weights of their kernel machines."""

    def __init__(self, samples: list[tuple[str, str]]):
        samples = sorted((lang, t) for lang, t in samples if lang and t and any(c.isalpha() for c in t))
        if not samples:
            raise ValueError("no labelled samples")
        self.languages = sorted({lang for lang, _ in samples})
        phi = np.zeros((len(samples), FEATURES), np.float32)
        for i, (_, t) in enumerate(samples):
            codes, passage = passages([t])[:2]
            phi[i, presence(codes, np.zeros_like(passage))[1]] = 1
        phi /= np.sqrt(phi.sum(axis=1, keepdims=True))
        y = np.array([[1.0 if lang == x else -1.0 for x in self.languages] for lang, _ in samples])
        marks = np.unique(np.linspace(0, len(samples) - 1, min(LANDMARKS, len(samples))).astype(int))
        base = phi[marks]
        value, vector = np.linalg.eigh((base @ base.T).astype(np.float64))
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])  # inverse square root of the landmarks' kernel
        z = (phi @ base.T) @ root
        mean = z.mean(axis=0)
        zc, bias = z - mean, y.mean(axis=0)
        alpha = np.linalg.solve(zc.T @ zc + RIDGE * len(samples) / len(self.languages) * np.eye(zc.shape[1]), zc.T @ (y - bias))
        self.weights = (base.T @ (root @ alpha)).astype(np.float32)
        self.bias = (bias - mean @ alpha).astype(np.float32)

    def score(self, codes: np.ndarray, passage: np.ndarray, count: int) -> np.ndarray:
        """Machine outputs by passage and language."""
        rows, features = presence(codes, passage)
        out = np.tile(self.bias, (count, 1))
        if len(rows):
            first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            n = np.diff(np.concatenate((first, [len(rows)])))
            out[rows[first]] += np.add.reduceat(self.weights[features], first, axis=0) / np.sqrt(n, dtype=np.float32)[:, None]
        return out

    def read(self, texts: list[str]) -> list[dict]:
        """Of each text: letters by language, the mixed languages, confidence and passages ``(start, language, confidence)``."""
        out: list[dict] = []
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (n == 0 or n + len(texts[b]) < BLOCK):
                n += len(texts[b]) + 1
                b += 1
            out += self._read(texts[a:b])
            a = b
        return out

    def _read(self, texts: list[str]) -> list[dict]:
        codes, passage, text, start, ends = passages(texts)
        count = len(text)
        letters = np.bincount(passage, codes > 0, minlength=count).astype(np.int64)
        score = self.score(codes, passage, count)
        best = score.argmax(axis=1)
        ranked = np.sort(score, axis=1)
        margin = ranked[:, -1] - ranked[:, -2] if score.shape[1] > 1 else ranked[:, -1] + 1
        # passages too short to judge join the neighbour before them in their text, else the one after
        sure = letters >= SHORT_LETTERS
        idx = np.arange(count)
        prev = np.maximum.accumulate(np.where(sure, idx, -1))
        nxt = np.minimum.accumulate(np.where(sure, idx, count)[::-1])[::-1]
        ok_prev = (prev >= 0) & (text[np.maximum(prev, 0)] == text)
        ok_next = (nxt < count) & (text[np.minimum(nxt, count - 1)] == text)
        own = np.where(sure, idx, np.where(ok_prev, prev, np.where(ok_next, nxt, idx)))
        lang = best[own]
        k = len(self.languages)
        by = np.bincount(text * k + lang, letters, minlength=len(texts) * k).reshape(len(texts), k)
        clear = np.bincount(text * k + lang, letters * np.maximum(margin, 0)[own], minlength=len(texts) * k).reshape(len(texts), k)
        # runs of passages in one language
        live = np.flatnonzero(letters > 0)
        t, g = text[live], lang[live]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (g[1:] != g[:-1]))) if len(live) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        size = np.bincount(run, letters[live]) if len(live) else np.zeros(0)
        sharp = np.bincount(run, letters[live] * np.maximum(margin[live], 0)) / np.maximum(size, 1) if len(live) else np.zeros(0)
        whole = np.bincount(run, ends[live]) > 0 if len(live) else np.zeros(0, bool)
        heads = live[new] if len(live) else live
        mixed: list[set] = [set() for _ in texts]
        pieces: list[list] = [[] for _ in texts]
        for i, h in enumerate(heads):
            pieces[text[h]].append((int(start[h]), self.languages[lang[h]], float(np.round(min(1.0, sharp[i]), 4))))
            if size[i] >= (PASSAGE_LETTERS if whole[i] else UNCLOSED_LETTERS) and sharp[i] >= CLEAR:
                mixed[text[h]].add(self.languages[lang[h]])
        out = []
        for i in range(len(texts)):
            total = by[i].sum()
            main = int(by[i].argmax())
            out.append({"counts": by[i].astype(int).tolist(), "language": self.languages[main] if total else None, "confidence": float(np.round(min(1.0, clear[i, main] / total), 4)) if total else None, "mixed": sorted(mixed[i]) if len(mixed[i]) > 1 else [], "passages": pieces[i]})
        return out


def fit(samples: DataFrame, language: str = "language", text: str = "text", bound: int = MAX_SAMPLES) -> Classifier:
    """A classifier of at most ``bound`` labelled samples, the same ones on every run."""
    rows = samples.select(F.col(language).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null").orderBy(F.xxhash64("l", "t")).limit(bound).collect()
    return Classifier([(r["l"], r["t"]) for r in rows])


def read_languages(df: DataFrame, model: Classifier, text: str, carry: list[str]) -> DataFrame:
    """``carry`` columns and ``counts, language, confidence, mixed, passages`` of each row's text."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)
    narrow = spread(df.select(*carry, F.col(text).cast("string").alias("__text")))
    schema = T.StructType([*[narrow.schema[c] for c in carry], *T._parse_datatype_string("counts array<int>, language string, confidence double, mixed array<string>, passages array<struct<start:int,language:string,confidence:double>>").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = sent.value.read(b["__text"].fillna("").tolist())
            b = b.drop(columns="__text")
            for c in ("counts", "language", "confidence", "mixed", "passages"):
                b[c] = pd.Series([[{"start": s, "language": x, "confidence": y} for s, x, y in g[c]] if c == "passages" else g[c] for g in got], index=b.index, dtype=object if c != "confidence" else "float64")
            yield b

    return narrow.mapInPandas(run, schema)


def latest(df: DataFrame, key: str, by: str, columns: list[str]) -> DataFrame:
    """One row per key: that with the greatest ``by`` (of equal ones the greatest row)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(by, *columns)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in columns])


def chunk_languages(chunks: DataFrame, model: Classifier) -> DataFrame:
    """``chunk_id, document_id, label, counts, language, confidence, mixed, passages``, one row per chunk."""
    read = read_languages(chunks.withColumn("label", F.col("language")), model, "text", ["chunk_id", "document_id", "label", "last_updated"])
    return latest(read, "chunk_id", "last_updated", ["document_id", "label", "counts", "language", "confidence", "mixed", "passages"])


def document_languages(chunks: DataFrame, model: Classifier) -> DataFrame:
    """``document_id, language, confidence`` of most letters in all its chunks, from :func:`chunk_languages`."""
    k = len(model.languages)
    sums = chunks.groupBy("document_id").agg(*[F.sum(F.element_at("counts", i + 1)).alias(f"n{i}") for i in range(k)])
    best = F.greatest(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(model.languages[i]).alias("l")) for i in range(k)]) if k > 1 else F.struct(F.col("n0").alias("n"), F.lit(model.languages[0]).alias("l"))
    total = sum((F.col(f"n{i}") for i in range(1, k)), F.col("n0"))
    return sums.where(total > 0).select("document_id", best["l"].alias("language"), F.round(best["n"] / total, 4).alias("confidence"))


def label_issues(chunks: DataFrame, documents: DataFrame, samples: DataFrame) -> DataFrame:
    """``(record_kind, record_id, issue, language)`` of all missing, wrong and mixed labels."""
    model = fit(samples)
    read = checkpoint(chunk_languages(chunks, model).select("chunk_id", "document_id", "label", "counts", "language", "confidence", "mixed"))  # the texts are scored once
    issue = lambda label: F.when(label_language(label).isNull(), "missing").when((label_language(label) != F.col("language")) & (F.col("confidence") >= DOUBT), "wrong")
    one = read.where("language is not null").select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), issue(F.col("label")).alias("issue"), "language").where("issue is not null")
    mixed = read.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("record_id"), F.lit("mixed").alias("issue"), F.explode("mixed").alias("language"))
    labels = latest(documents.withColumnRenamed("language", "label"), "document_id", "ingestion_timestamp", ["label"])
    whole = document_languages(read, model).join(labels, "document_id")
    docs = whole.select(F.lit("document").alias("record_kind"), F.col("document_id").alias("record_id"), issue(F.col("label")).alias("issue"), "language").where("issue is not null")
    return one.unionByName(mixed).unionByName(docs)
