"""Language of a text: its family first, then one-versus-one linear SVMs within the family.

Features are hashed byte trigrams of the whole text, letters only, with square-root counts of unit length. The SVMs are
fitted by accelerated gradient descent on at most ``sample`` labelled texts per language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import schema_with, texts

UNKNOWN = "und"
#: Texts a language is fitted on at most; a fixed bound, so the fit does not grow with the input.
SAMPLE = 600
#: Score from which a language is known: more likely than all others together.
KNOWN = 0.5
FEATURE_BITS = 12
#: Families of languages; a language that is not listed is a family of its own.
FAMILIES: Mapping[str, str] = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ca", "ro", "gl"), "romance"),
    **dict.fromkeys(("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("tr", "az", "kk"), "turkic"),
    **dict.fromkeys(("hi", "bn", "ur", "mr", "fa"), "indo-iranian"),
}
_BLANK = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def features(text: bytes | None, bits: int = FEATURE_BITS) -> np.ndarray | None:
    """Feature vector of a text, or None without a letter."""
    if not text:
        return None
    decoded = text.decode("utf-8", "replace").lower()
    if not any(map(str.isalpha, decoded)):  # Unicode's letters; neither numbers nor marks
        return None
    words = b" " + b" ".join(decoded.encode().translate(_BLANK).split()) + b" "
    raw = np.frombuffer(words, np.uint8).astype(np.uint32)
    if len(raw) < 3:
        raw = np.resize(raw, 3)
    grams = (raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16) * np.uint32(2654435761)
    counts = np.sqrt(np.bincount(grams >> np.uint32(32 - bits), minlength=1 << bits)).astype(np.float32)
    return counts / np.linalg.norm(counts)


def fit_svm(x: np.ndarray, positive: np.ndarray, decay: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, classes weighed alike."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w, ahead = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(2))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1])) * y * share
        slope = decay * ahead
        slope[:-1] -= 2 * (slack @ x)
        slope[-1] -= 2 * slack.sum()
        new = ahead - slope / 4  # rows have unit length, so the slope changes by at most 4 per unit step
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-3 * margin))


@dataclass
class LanguageModel:
    """Fitted weights: one SVM per family against the rest, and one per pair of languages in a family."""

    bits: int = FEATURE_BITS
    families: dict[str, list[str]] = field(default_factory=dict)
    by_family: dict[str, np.ndarray] = field(default_factory=dict)
    by_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        x = features(text, self.bits) if self.families else None
        if x is None:
            return UNKNOWN, 0.0
        names = list(self.families)
        sure = np.array([_sure(x @ self.by_family[f][:-1] + self.by_family[f][-1]) if len(names) > 1 else 1.0 for f in names])
        best = int(np.argmax(sure))
        family, score = names[best], float(sure[best] / sure.sum())
        votes = dict.fromkeys(self.families[family], 0.0)
        for a, b in combinations(self.families[family], 2):
            w = self.by_pair[a, b]
            p = float(_sure(x @ w[:-1] + w[-1]))
            votes[a] += p
            votes[b] += 1 - p
        lang = max(votes, key=lambda k: (votes[k], k))
        others = len(votes) - 1
        return lang, min(1.0, max(0.0, score * (votes[lang] / others if others else 1.0)))


def fit_languages(
    labelled: DataFrame, sample: int = SAMPLE, bits: int = FEATURE_BITS, families: Mapping[str, str] = FAMILIES
) -> LanguageModel:
    """Fit on rows ``text, lang``: per language about ``sample`` different texts, picked by a hash of the text.

    Rows without language or letter are left out. Vectors are made on the executors; the driver gets at most ``sample``
    vectors per language. Which texts are picked does not depend on ids, partitions or repeats.
    """
    known = labelled.select(F.col("text").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        "lang is not null and text is not null"
    )
    keyed = known.select("lang", "text", F.xxhash64("text", F.lit("fit")).alias("h"))
    sizes = {
        r["lang"]: r["n"]
        for r in keyed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    }
    if not sizes:
        return LanguageModel(bits=bits)
    share = F.create_map(
        *[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, 1.2 * sample / max(1, n))))]
    )
    picked = keyed.where(
        F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53) < share[F.col("lang")]
    )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (lang, h, x.tobytes())
                for lang, h, t in zip(
                    batch.column("lang").to_pylist(), batch.column("h").to_pylist(), texts(batch), strict=True
                )
                if (x := features(t, bits)) is not None
            ]
            yield pa.RecordBatch.from_pydict(
                {"lang": [r[0] for r in rows], "h": [r[1] for r in rows], "x": [r[2] for r in rows]},
                schema=pa.schema([("lang", pa.string()), ("h", pa.int64()), ("x", pa.binary())]),
            )

    found = picked.mapInArrow(vectors, "lang string, h long, x binary").groupBy("lang", "h").agg(F.first("x").alias("x"))
    by_lang: dict[str, list[tuple[int, bytes]]] = {}
    for r in found.collect():
        by_lang.setdefault(r["lang"], []).append((r["h"] & ((1 << 64) - 1), bytes(r["x"])))
    langs = sorted(by_lang)
    x, y = [], []
    for lang in langs:
        for _, raw in sorted(by_lang[lang])[:sample]:
            x.append(np.frombuffer(raw, np.float32))
            y.append(lang)
    model = LanguageModel(bits=bits)
    if not x:
        return model
    rows, names = np.stack(x), np.array(y)
    for lang in langs:
        model.families.setdefault(families.get(lang, lang), []).append(lang)
    kin = np.array([families.get(n, n) for n in names])
    for family, members in model.families.items():
        if len(model.families) > 1:
            model.by_family[family] = fit_svm(rows, kin == family)
        for a, b in combinations(members, 2):
            two = (names == a) | (names == b)
            model.by_pair[a, b] = fit_svm(rows[two], names[two] == a)
    return model


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Every row with ``lang_pred`` and ``score`` added (columns of those names in the input are replaced).

    Only ``text`` is read. Texts that are NULL, empty or without a letter are ``und`` with score 0; so is every text when
    the model was fitted on nothing. Equal texts get equal results.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    named = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(columns)])
    at = f"c{columns.index('text')}"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in texts(batch, at)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    schema = schema_with(named, lang_pred="string", score="double")
    out = named.mapInArrow(predict, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "lang_pred", "score")


def held_out() -> Column:
    """Whether a document's label is kept from the fit: the remainder of its id's checksum by 4 is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known_languages(docs: DataFrame, min_score: float = KNOWN, sample: int = SAMPLE) -> DataFrame:
    """The rows whose language is known, with the input's columns: no letters, or a lower score, and a row goes.

    The model is fitted on the labelled rows that are not held out. If no row has a label, all with a letter stay.
    """
    model = fit_languages(docs.where(~held_out()).select("text", "lang"), sample)
    if not model.families:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    columns = docs.columns
    named = docs.select(*[docs[c].alias("text" if c == "text" else f"k{i}") for i, c in enumerate(columns)])
    kept = predict_languages(named, model).where(F.col("lang_pred") != UNKNOWN).where(F.col("score") >= min_score)
    return kept.select(*[F.col("text" if c == "text" else f"k{i}").alias(c) for i, c in enumerate(columns)])
