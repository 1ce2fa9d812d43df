"""Ids of a public byte-level vocabulary file, as the tokenizers library gives them, by whichever library is fastest."""

from __future__ import annotations

import json
import os
from functools import cached_property, lru_cache

#: Bytes that a vocabulary file writes as the letter of the same code; the others follow from code 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def letters() -> dict[str, int]:
    """The byte that each letter of a vocabulary file stands for."""
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """Texts to ids. ``special``: the text of a special token is its id, else it is text like any other.

    With merges in the order of their ids the ranks of the tiktoken library are the ids, and both libraries give the
    same; it takes a quarter of the time. Where it gives up (a run of about a million blanks) the tokenizers library
    goes on, and with merges in any other order it does all.
    """

    def __init__(self, path: str, special: bool):
        self.path, self.special = path, special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, ids = letters(), spec["model"]["vocab"]
        extra = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.raw = {i: bytes(byte[c] for c in t) for t, i in ids.items() if t not in extra and all(c in byte for c in t)}
        self.raw |= {i: t.encode() for t, i in extra.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [ids[a + b] for a, b in pairs]
        self.fast = None
        if made == sorted(set(made)) and len(made) + 256 == len(ids) - len(extra.keys() & ids.keys()):
            import public_tokenizers
            import tiktoken

            ranks = {t: i for i, t in self.raw.items() if i not in extra.values()}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=extra)
            self.fast = (lambda text: fast.encode(text, allowed_special="all")) if special else fast.encode_ordinary

    @cached_property
    def slow(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.no_truncation()
        model.no_padding()
        model.encode_special_tokens = not self.special
        return model

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast(text)
            except ValueError:
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(2)
def byte_pairs(path: str, special: bool) -> BytePairs:
    return BytePairs(path, special)
