"""Helpers of the subpackage: cut lineage, read a tokenizer."""

from __future__ import annotations

from functools import lru_cache

from ..operators.lineage import cut_lineage

__all__ = ["TOKENIZERS", "cut_lineage", "encoding"]

TOKENIZERS = "/opt/tokenizers"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken encoding of a rank file; the split pattern is that of the public package beside it."""
    import base64
    import importlib.util

    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizer_folder", path.rpartition("/")[0] + "/__init__.py")
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=m.PATTERN, mergeable_ranks=ranks, special_tokens={})
