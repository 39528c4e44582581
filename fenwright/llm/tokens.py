"""Token ids of byte-level BPE tokenizer files.

The ids are those of the `tokenizers` library for the file. Where the file is a plain byte-level BPE whose ids follow the
order of its merges, the same ids are computed by `tiktoken`, which needs a quarter of the CPU time; any other file is
read by `tokenizers` itself."""

from __future__ import annotations

import functools
import json

import numpy as np

#: Pre-tokenizer pattern of the byte-level BPE files (fixed value of the file format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """Byte-level files write each byte as a printable character: itself if printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    out.update({chr(256 + i): b for i, b in enumerate(rest)})
    return out


def _fast(spec: dict):
    """A tiktoken encoding for the file, or None if the file is of another kind."""
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    added = spec.get("added_tokens") or []
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") and not t.get("special") for t in added):
        return None
    special = {t["content"]: t["id"] for t in added}
    byte_of = _byte_of_char()
    try:
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    except KeyError:
        return None
    last = -1
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if (i := model["vocab"].get(a + b, -1)) <= last:
            return None
        last = i
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=4)
def encoder(path: str, fast: bool = True):
    """A function from a text to its ids, a numpy array of unsigned 32-bit integers."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    slow = functools.cache(lambda: _library(path))
    if not fast or not (e := _fast(spec)):
        return slow()

    def ids(text: str) -> np.ndarray:
        try:
            return np.asarray(e.encode(text, allowed_special="all"), dtype="<u4")
        except (ValueError, RuntimeError, UnicodeError):  # e.g. a run of blanks beyond the pattern engine's limit
            return slow()(text)

    return ids


def _library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: np.asarray(t.encode(text, add_special_tokens=False).ids, dtype="<u4")
