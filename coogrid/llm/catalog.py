"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import embeddings_query
from .language import language_query
from .licenses import licenses_query
from .ordermin import ordermin_query
from .packing import packing_query
from .pii import pii_query
from .quality import quality_query
from .resampling import RESAMPLING_SQL, resampling_query
from .segmentation import segmentation_query
from .simhash import simhash_query
from .toxicity import toxicity_query
from .warc import WARC_SQL, warc_query
from .whitening import whitening_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_pivots": embeddings_query,
    "op2_sentencepiece_nbest": segmentation_query,
    "op3_quality_fm": quality_query,
    "op4_packing_grouping": packing_query,
    "op5_license_patience": licenses_query,
    "op6_simhash_bytes": simhash_query,
    "op7_language_zstd": language_query,
    "op8_pii_weak": pii_query,
    "op9_order_minhash": ordermin_query,
    "op10_toxicity_mil": toxicity_query,
    "op11_importance_resampling": resampling_query,
    "op12_warc_index": warc_query,
    "op13_embedding_whitening": whitening_query,
}
#: The others cannot be expressed: learnt models, compression, tokenizers, iterated components, eigenvectors.
SQL: dict[str, str] = {"op11_importance_resampling": RESAMPLING_SQL, "op12_warc_index": WARC_SQL}
