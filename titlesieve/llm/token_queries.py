"""Registered queries of the operators that encode texts."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers

from titlesieve.llm import sentencepiece_sampling, token_output
from titlesieve.llm.registry import query, table
from titlesieve.sources.storage import scratch_folder


@query("op5_token_output")
def op5_token_output(spark, sf_dir):
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    path = scratch_folder(spark, "token-shards")
    token_output.write_shards(table(spark, sf_dir, "documents"), vocabulary, path)
    return token_output.document_digests(spark, path)


def piece_model() -> bytes:
    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    return sentencepiece_sampling.digests(table(spark, sf_dir, "documents"), piece_model())
