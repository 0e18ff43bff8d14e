"""Exact byte-pair token ids and counts for whole Arrow batches.

The vocabulary's splitting pattern starts a new piece before every space that
a visible character follows, so a text's tokens are those of its parts cut at
spaces, each with the space before it. Arrow cuts the batch and finds its
distinct parts; only those that no earlier batch had are encoded. A text with
a space that follows white space and that no visible character follows is
encoded as a whole, as the cut would not be exact there.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftstone.llm.textbatch import chunks, plain, released

#: Where the public vocabularies are; a parameter of every operator that counts tokens.
VOCABULARY = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")
#: Distinct parts that a Python worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Bytes of text that are cut at once, for ids and for counts.
CUT_BYTES, COUNTED_BYTES = 4 << 20, 1 << 20

_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = _WHITE + " (?:" + _WHITE + "|$)"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """One vocabulary with what it has encoded so far."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, tuple[int, ...]] = {}
        self.sizes: dict[str, int] = {}  # small numbers are shared: a fraction of the memory of ids

    def _parts(self, parts: list[str], known: dict, make: Callable) -> list:
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for p in parts:
            got = known.get(p)
            if got is None:
                got = known[p] = make(self.encode(p))
            out.append(got)
        return out

    def _coded(self, texts: pa.Array, known: dict, make: Callable) -> tuple[np.ndarray, np.ndarray, list]:
        """Offsets of the texts' parts, each part's place in the list of encoded parts, that list: what ``make`` makes of their ids, as in ``known``."""
        whole = np.asarray(pc.match_substring_regex(texts, _UNSAFE))
        cut = pc.split_pattern(pc.if_else(pa.array(~whole), texts, ""), " ")
        at = np.asarray(cut.offsets, dtype=np.int64)
        coded = cut.flatten().dictionary_encode()
        place = np.asarray(coded.indices, dtype=np.int64).copy()
        distinct = [" " + p for p in coded.dictionary.to_numpy(zero_copy_only=False)]
        first = list(pc.list_element(cut, 0).to_numpy(zero_copy_only=False)) if len(texts) else []
        if whole.any():
            for k in np.flatnonzero(whole):
                first[k] = None
        ids = self._parts(distinct, known, make)
        place[at[:-1]] = np.arange(len(texts)) + len(ids)
        ids += [self._parts([p], known, make)[0] if p is not None else make(self.encode(texts[k].as_py())) for k, p in enumerate(first)]
        return at, place, ids

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; 0 for null and empty texts."""
        texts = plain(texts)
        out = np.zeros(len(texts), np.int64)
        for begin, some in chunks(texts, COUNTED_BYTES):
            at, place, sizes = self._coded(some, self.sizes, len)
            total = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64)[place])])
            out[begin : begin + len(some)] = total[at[1:]] - total[at[:-1]]
            del at, place, sizes, total
            released()
        return out

    def ids(self, texts: pa.Array) -> pa.Array:
        """Token ids of each text as a list; an empty list for null and empty texts."""
        texts = plain(texts)
        out = []
        for _, some in chunks(texts, CUT_BYTES):
            at, place, ids = self._coded(some, self.known, tuple)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
            begins = np.concatenate([[0], np.cumsum(size)])[:-1]
            n = size[place]
            ends = np.cumsum(n)
            values = flat[np.repeat(begins[place] - (ends - n), n) + np.arange(ends[-1])]
            offsets = np.concatenate([[0], ends])[at]
            out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)
