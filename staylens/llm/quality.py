"""Quality rules: what public tokenisers make of a text, held against bands for its language or script."""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, raw_texts, str_texts

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Bounds within which a text is kept."""

    byte_chars_per_token: tuple[float, float]  # by the byte-level vocabulary
    piece_chars_per_token: tuple[float, float]  # by the vocabulary with byte fallback
    fallback_share: float  # at most, of the tokens of the latter
    entropy: tuple[float, float]  # in bits, of the same tokens


#: By language: what fit_bands() gives on the given documents at a tenth of their full size (quantile 0.001 of the rows
#: labelled good, in a sample of 5,000 rows: 1,016 en, 272 de, 247 fr, 168 es), less seven percent. There the quantiles of
#: the characters per token were 2.42 and 2.34 (en), 2.53 and 2.38 (de), 2.25 and 2.15 (fr), 2.31 and 2.14 (es), of entropy
#: 5.7 to 5.8 bits, and the largest fallback share 0.04. The bound of entropy is lower than that, for plain prose of few words,
#: and the upper bounds are of natural prose, which these tables lack.
LANGUAGES = {
    "en": Band((2.25, 9.0), (2.17, 9.0), 0.10, (4.0, 12.0)),
    "de": Band((2.35, 9.0), (2.21, 9.0), 0.10, (4.0, 12.0)),
    "fr": Band((2.09, 9.0), (1.99, 9.0), 0.10, (4.0, 12.0)),
    "es": Band((2.15, 9.0), (1.98, 9.0), 0.10, (4.0, 12.0)),
}
#: By the script of most letters, where the language is none of the above. Bounds lie between what sentences of the first
#: article of the Declaration of Human Rights come to and what random letters of the script do; for instance 0.89 and
#: 0.53 characters per byte-level token and 0.05 and 0.93 of fallback for Chinese, 3.27 and 1.13 characters for Russian.
SCRIPTS = {
    "LATIN": Band((1.8, 12.0), (1.85, 12.0), 0.15, (3.0, 12.0)),
    "CYRILLIC": Band((1.8, 12.0), (1.6, 12.0), 0.10, (3.0, 12.0)),
    "GREEK": Band((1.3, 12.0), (0.9, 12.0), 0.08, (3.0, 12.0)),
    "CJK": Band((0.65, 6.0), (0.6, 6.0), 0.50, (3.0, 12.0)),
    "HIRAGANA": Band((0.9, 6.0), (0.75, 6.0), 0.35, (3.0, 12.0)),
    "KATAKANA": Band((0.9, 6.0), (0.75, 6.0), 0.35, (3.0, 12.0)),
    "HANGUL": Band((0.8, 6.0), (0.6, 6.0), 0.50, (3.0, 12.0)),
    "ARABIC": Band((1.3, 9.0), (0.9, 9.0), 0.12, (3.0, 12.0)),
    "HEBREW": Band((1.45, 9.0), (0.9, 9.0), 0.10, (3.0, 12.0)),
    "DEVANAGARI": Band((0.78, 9.0), (0.7, 9.0), 0.35, (3.0, 12.0)),
    "THAI": Band((0.88, 9.0), (0.85, 9.0), 0.20, (3.0, 12.0)),
    "": Band((0.4, 12.0), (0.4, 12.0), 0.75, (2.5, 12.0)),
}


@dataclass(frozen=True)
class Rules:
    """Parameters of the quality rules; paths are of files that the workers can read."""

    piece_path: str
    byte_path: str
    pattern: str
    languages: dict[str, Band] = field(default_factory=lambda: dict(LANGUAGES))
    scripts: dict[str, Band] = field(default_factory=lambda: dict(SCRIPTS))
    least_words: int = 50
    repeat_percent: int = 50


@functools.cache
def _piece_model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.vocab_size())], bool)


@functools.cache
def _byte_model(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("quality", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of `width` words found twice or more in the text, the first included."""
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    code = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    window = code[: len(code) - width + 1]
    for k in range(1, width):
        # renumbered after each word, so that the product of two codes fits
        window = np.unique(window * len(known) + code[k : len(code) - width + 1 + k], return_inverse=True)[1]
    often = np.bincount(window)[window] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(often)] += often
    edge[width : width + len(often)] -= often
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """The first word of the Unicode name that most letters of the text bear."""
    seen: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            seen[unicodedata.name(c, "").split(" ")[0]] += n
    return max(seen, key=lambda k: (seen[k], k), default="")


def _measures(rules: Rules, texts: list[str], raw: list[bytes], langs: list[str | None]) -> Iterator[tuple]:
    model, is_byte = _piece_model(rules.piece_path)
    fine = _byte_model(rules.byte_path, rules.pattern)
    for text, data, lang, ids in zip(texts, raw, langs, model.encode(texts, num_threads=1), strict=True):
        words = data.split()
        chars = len(text)
        found = np.array(ids, np.int64)
        times = np.bincount(found)
        times = times[times > 0]
        share = times / max(1, len(found))
        entropy = float(-(share * np.log2(share)).sum()) if len(found) else 0.0
        n_fine = len(fine.encode_ordinary(text))
        repeats = repeated_words(words)
        by_byte, by_piece = chars / max(1, n_fine), chars / max(1, len(found))
        fallback = float(is_byte[found].mean()) if len(found) else 0.0
        band = rules.languages.get(lang or "") or rules.scripts.get(script(text)) or rules.scripts[""]
        base_failed = len(words) < rules.least_words or 100 * repeats > rules.repeat_percent * len(words)
        inside = band.byte_chars_per_token[0] <= by_byte <= band.byte_chars_per_token[1] and band.piece_chars_per_token[0] <= by_piece <= band.piece_chars_per_token[1] and fallback <= band.fallback_share and band.entropy[0] <= entropy <= band.entropy[1]
        n_space = len(data) - len(data.translate(None, _SPACE))
        yield len(words), chars - n_space, len(data) - len(data.translate(None, _SYMBOLS)), repeated_lines(data), repeats, by_byte, by_piece, fallback, entropy, base_failed, inside and not base_failed


#: Columns that score() adds.
MEASURES = [
    ("n_words", T.LongType(), pa.int64()),
    ("word_chars", T.LongType(), pa.int64()),
    ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()),
    ("n_repeat_words", T.LongType(), pa.int64()),
    ("byte_chars_per_token", T.DoubleType(), pa.float64()),
    ("piece_chars_per_token", T.DoubleType(), pa.float64()),
    ("fallback_share", T.DoubleType(), pa.float64()),
    ("token_entropy", T.DoubleType(), pa.float64()),
    ("base_failed", T.BooleanType(), pa.bool_()),
    ("kept", T.BooleanType(), pa.bool_()),
]


def _score(rules: Rules, keep: list[str], only_kept: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text", 1 << 20):
            text, lang = batch.column("text"), batch.column("lang").to_pylist()
            rows = list(_measures(rules, str_texts(text), raw_texts(text), lang))
            made = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(MEASURES)]
            if only_kept:
                yield pa.RecordBatch.from_arrays([batch.column(x) for x in keep], keep).filter(made[-1])
            else:
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), *made], [*keep, *(x[0] for x in MEASURES)])


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id and the columns of MEASURES for each row of docs (doc_id, text, lang; further columns are left alone).

    Each row is judged by itself, in one pass without a shuffle. A null text has no words and fails, as any text of
    fewer than least_words; a null or unknown lang is judged by script; null doc_ids stay; repeated rows each give one.
    Characters per token count all code points of the text; without tokens they are those of one token.
    """
    docs = docs.select("doc_id", "text", "lang")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t, _ in MEASURES)])
    return docs.mapInArrow(lambda it: _score(rules, ["doc_id"], False, it), schema)


def keep_good(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns: null, empty and short texts go, repeated rows share a verdict, an
    empty table stays empty."""
    names = docs.columns
    return docs.mapInArrow(lambda it: _score(rules, names, True, it), docs.schema)


def fit_bands(docs: DataFrame, labels: DataFrame, rules: Rules, quantile: float = 0.001, slack: float = 0.07) -> DataFrame:
    """For each lang: n, and bounds from the rows that labels (doc_id, quality) call good (1) and that pass the base rules.

    byte_low, piece_low and entropy_low are the quantile less slack, fallback_high the opposite quantile and slack more.
    Quantiles are over all labelled rows. Rows without a lang are one group; unlabelled and null ids are left out;
    repeated rows count each; no labels give no rows.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct()
    rows = docs.join(good, "doc_id", "left_semi").select(F.struct("doc_id", "lang").alias("doc_id"), "text", "lang")
    told = score(rows, rules).filter("not base_failed")
    at = lambda c, q: F.percentile(c, F.lit(q))
    return told.groupBy(F.col("doc_id.lang").alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), *[(at(c, quantile) * (1 - slack)).alias(n) for c, n in (("byte_chars_per_token", "byte_low"), ("piece_chars_per_token", "piece_low"), ("token_entropy", "entropy_low"))], (at("fallback_share", 1 - quantile) * (1 + slack)).alias("fallback_high")
    )
