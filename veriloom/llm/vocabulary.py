"""Where the public vocabulary files are; a worker looks on its own machine."""

from __future__ import annotations


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
