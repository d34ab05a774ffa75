"""Language ID by compression.

One zstandard raw-content dictionary per language is cut from a bounded sample of
labelled texts; a text has the language whose dictionary makes it smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fold, keep_rows

UNKNOWN = "und"
#: Labelled texts sampled per language, bytes of each, and bytes of a dictionary.
SAMPLE_TEXTS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 320, 64 * 1024
#: Whole texts are compressed in blocks, so that a dictionary counts throughout a long text.
BLOCK_BYTES = 8192
#: A text is rejected when the best language saves at most this share of the runner-up's bytes: always where both are equal.
NARROW_MARGIN = 0.002
#: Margin that scores a half.
HALF_MARGIN = 0.02
_PARAMETERS = {
    "window_log": 17, "chain_log": 16, "hash_log": 15, "search_log": 4, "min_match": 4, "target_length": 8,
    "strategy": zstandard.STRATEGY_LAZY, "write_checksum": 0, "write_content_size": 0, "write_dict_id": 0,
}


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, the most frequent language first (it wins ties)."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
        for content in self.dictionaries:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=parameters)
            made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=parameters))
        return made


def fit(docs: DataFrame, held: tuple[int, int] | None = None, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn dictionaries from windows of about ``SAMPLE_TEXTS`` texts per language; ids in the fold ``held`` take no part.

    A sampled text gives up to four windows of ``SAMPLE_BYTES``, apart from each other; they fill
    ``DICTIONARY_BYTES`` in an order drawn by hash, and what is left over is not used.

    Rows with a null language or a text without letters teach nothing; with no row left
    the model has no language and predicts ``und`` everywhere.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    if held:
        rows = rows.where(~fold("doc_id", *held))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang).alias("l")).count().collect()}
    if not counts:
        return LanguageModel((), ())
    order = F.pmod(F.xxhash64("doc_id", F.lit("window")), F.lit(1 << 30))
    # One threshold per language, so each gives about as many windows and the driver gets a bounded number.
    share = F.coalesce(
        *(F.when(F.col(lang) == g, F.lit(int(min(1.0, SAMPLE_TEXTS / n) * (1 << 30)))) for g, n in counts.items())
    )
    chosen = rows.where(order < share).select("doc_id", F.col(lang).alias("l"), F.col(text).alias("t"))

    def windows() -> Callable:
        def kernel(ids: list, langs: list, texts: list):
            for i, g, t in zip(ids, langs, texts, strict=True):
                content = t.lower().encode("utf-8", "replace")
                # Up to four windows a text, spread over it, none over another.
                step = max(SAMPLE_BYTES, len(content) // 4)
                for at in range(0, len(content), step):
                    yield hash_order(f"{i}:{at}"), g, content[at : at + SAMPLE_BYTES]

        return kernel

    found = arrow_map(chosen, windows, "place long, l string, w binary").collect()
    by: dict[str, list] = {}
    for place, g, w in sorted((r[0], r[1], bytes(r[2])) for r in found):
        by.setdefault(g, []).append((place, w))
    names = sorted(by, key=lambda g: (-counts[g], g))
    return LanguageModel(
        tuple(names), tuple(b"\n".join(w for _, w in by[g])[:DICTIONARY_BYTES].ljust(8, b" ") for g in names)
    )


def hash_order(key: str) -> int:
    import zlib

    return zlib.crc32(key.encode())


def predictor(model: LanguageModel) -> Callable[[Sequence[str | None]], list[tuple[str, float, bool]]]:
    """Kernel that gives (language, score, rejected) per text; made once per task.

    The score is margin / (margin + ``HALF_MARGIN``) where the margin is the share
    by which the smallest size is below the next; a single language scores 1.  One rule
    rejects at all lengths: a margin of ``NARROW_MARGIN`` or less.  Null texts and texts
    without a letter are ``und`` with score 0 and rejected.
    """
    compressors = model.compressors()

    def sizes(content: bytes) -> list[int]:
        blocks = [content[at : at + BLOCK_BYTES] for at in range(0, len(content), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in compressors]

    def one(text: str | None) -> tuple[str, float, bool]:
        if text is None or not compressors or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        content = text.lower().encode("utf-8", "replace")
        found = sizes(content)
        best = min(found)
        at = found.index(best)
        if len(found) == 1:
            return model.languages[0], 1.0, False
        rival = min(found[:at] + found[at + 1 :])
        margin = (rival - best) / rival
        return model.languages[at], margin / (margin + HALF_MARGIN), margin <= NARROW_MARGIN

    return lambda texts: [one(t) for t in texts]


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row; whole texts, rows repeated as given."""

    def make():
        predict = predictor(model)
        return lambda ids, texts: [(i, *p) for i, p in zip(ids, predict(texts), strict=True)]

    plain = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("t"))
    return arrow_map(plain, make, "doc_id long, lang_pred string, score double, rejected boolean")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected, with the columns they came with."""
    model = fit(docs)

    def make():
        predict = predictor(model)
        return lambda texts: [not rejected for _, _, rejected in predict(texts)]

    return keep_rows(docs, "text", make)


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from ids whose crc32 mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict_language(docs, fit(docs, held=(4, 2)))
    return found.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
