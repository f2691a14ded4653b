"""Token ids of texts as numpy arrays, for a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from docloom.llm.token_counts import PRE_TOKEN, _byte_symbols


@lru_cache(maxsize=2)
def text_encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function that gives a text's ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` does.

    Where the ids are also the order of the merges, plain byte-level pre-tokens are used and special tokens have no
    rules of their own, the same ids come several times faster from tiktoken; any other file, and any text that its
    pattern engine refuses (a million spaces on end), goes through the tokenizers library itself.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    slow = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _ranks(spec)
    if ranks is None:
        return slow
    import tiktoken

    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    coder = tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)

    def fast(text: str) -> np.ndarray:
        try:
            return coder.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return slow(text)

    return fast


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each symbol to its id, if ids follow the merges and nothing else shapes the result."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        return None
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False:
        return None
    added = spec.get("added_tokens", [])
    if len(added) > 1 or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
        return None
    symbols = _byte_symbols()
    back = {s: b for b, s in enumerate(symbols)}
    vocab = {k: v for k, v in model["vocab"].items() if k not in {t["content"] for t in added}}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if sorted(vocab.get(s, -1) for s in symbols) != list(range(256)) or [vocab.get(m) for m in merged] != list(range(256, len(vocab))):
        return None
    return {bytes(back[c] for c in k): v for k, v in vocab.items()}
