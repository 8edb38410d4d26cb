"""Token ids of whole texts with a public tokenizer, each distinct unit of text encoded once per worker.

A byte-level pre-tokenizer never joins a non-space character with a following space, so a text whose
white space comes in single characters may be cut before each U+0020: units between the cuts are
encoded on their own, and putting their ids together gives the ids of the whole text. Any other
text is encoded as it is. ``tests/llm/test_encode.py`` compares both with whole-text encoding.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units kept by a worker before its memory of them starts anew (about 50 bytes each).
KEEP_UNITS = 800_000
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}|\A[\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}]\z|\A\z|\x00"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Units after a cut are keyed by what follows their space, first units by a NUL and their text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.opens = np.array([t.startswith("Ġ") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])], bool)
        self._clear()

    def _clear(self) -> None:
        self.units = pa.array([], pa.string())
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), np.array([len(x) for x in found], np.int64)

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of units without a space: joined by spaces, a token that opens with one opens a unit."""
        ids, _ = self._whole([" " + " ".join(units[k : k + 256]) for k in range(0, len(units), 256)])
        at = np.flatnonzero(self.opens[ids])
        return ids, np.diff(np.r_[at, len(ids)])

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """Encodes and keeps new units; returns their places."""
        is_first = pc.starts_with(fresh, "\0")
        later, first = fresh.filter(pc.invert(is_first)), fresh.filter(is_first)
        a, na = self._joined(later.to_pylist())
        b, nb = self._whole(pc.utf8_slice_codeunits(first, 1).to_pylist())
        size = np.r_[na, nb].astype(np.int32)
        mask, known = is_first.to_numpy(zero_copy_only=False), len(self.units)
        places = known + np.where(mask, len(later) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)
        self.units = pa.concat_arrays([self.units, later, first])
        self.start = np.r_[self.start, (len(self.ids) + np.cumsum(size) - size).astype(np.int32)]
        self.size = np.r_[self.size, size]
        self.ids = np.r_[self.ids, a, b]
        return places

    def _by_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.binary_join_element_wise("\0", texts, ""), " ")
        units = split.flatten().dictionary_encode()
        if len(self.units) > KEEP_UNITS:
            self._clear()
        found = pc.index_in(units.dictionary, value_set=self.units)
        places = found.fill_null(-1).to_numpy().copy()
        places[places < 0] = self._learn(units.dictionary.filter(pc.is_null(found)))
        at = places[units.indices.to_numpy()]
        size = self.size[at]
        ends = np.cumsum(size, dtype=np.int64)
        place = np.repeat(self.start[at] - (ends - size), size)
        place += np.arange(len(place))
        ids = self.ids[place]
        return ids, np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string column without nulls, as uint32 arrays."""
        odd = pc.match_substring_regex(texts, _ODD)
        mask = odd.to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        if not mask.all():
            ids, bounds = self._by_units(texts.filter(pc.invert(odd)))
            for k, doc in enumerate(np.flatnonzero(~mask)):
                out[doc] = ids[bounds[k] : bounds[k + 1]]
        for doc in np.flatnonzero(mask):
            out[doc] = np.array(self.tokenizer.encode(texts[int(doc)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    return Encoder(path)
