"""Byte-level BPE of a ``tokenizers`` file, run by the faster of two libraries that give the same ids."""

from __future__ import annotations

import functools
import json

import numpy as np

# The split pattern of byte-level BPE with ``use_regex``.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    A file whose merges are numbered in the order of their ids, with plain byte-level
    splitting, runs on ``tiktoken``; any other file runs on ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._fast = None
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model.get("merges", [])]
        made = [model["vocab"].get(a + b, -1) for a, b in merges] if merges else []
        if (
            made
            and made == sorted(made)
            and made[0] >= 256
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            import tiktoken

            letters = _byte_of_letter()
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
            self._fast = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    @functools.cached_property
    def _whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(text, allowed_special="all")
            except Exception:  # the pattern engine gives up on extreme runs of white space; the other library doesn't
                pass
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids) -> str:
        return self._whole.decode([int(i) for i in ids], skip_special_tokens=False)


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
