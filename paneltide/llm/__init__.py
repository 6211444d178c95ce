"""Operators of a training-data pipeline; nothing else in the library imports this package."""


def load_all() -> None:
    """Register the queries of all operators."""
    from paneltide.llm import (bpe, langid, lexical, line_dedup, lm_scoring, manifest, mixing, near_vectors,  # noqa: F401
                               ngram_join, substrings, token_files, topk, warc)
