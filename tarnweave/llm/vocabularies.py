"""Where public vocabulary files are; a parameter of every operator that needs one."""

from __future__ import annotations


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
