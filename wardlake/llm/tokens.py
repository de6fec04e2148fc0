"""Token ids of whole texts, in Arrow batches.

Text is cut at ASCII white space, which the tokenizer drops, so pieces can be encoded
alone. A piece made of Latin letters and trailing ASCII punctuation is encoded as two
parts; letters are lower-cased first. New words are encoded together and told apart by
the mark that a word's last token carries. All other pieces go to the tokenizer as they
stand. Known parts are kept by a bounded table per Python worker.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow_rows import batches

#: Parts a worker remembers before it starts anew.
KEEP_PARTS = 600_000
SIMPLE = r"^(?P<w>[a-zß-öø-ÿ]+)(?P<p>[!-/:-@\[-`{-~]*)$"
WORD_END = "</w>"


class _Parts:
    """Ids of distinct parts, one after another, with their starts."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([""], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(2, np.int64)

    def find(self, wanted: pa.Array) -> np.ndarray:
        """The number of each wanted part (no nulls)."""
        if len(self.known) > KEEP_PARTS:
            self.clear()
        table = wanted.dictionary_encode()
        at = pc.index_in(table.dictionary, value_set=self.known)
        new = table.dictionary.filter(at.is_null())
        number = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            ids, sizes = self.encode(new.to_pylist())
            number[number < 0] = len(self.known) + np.arange(len(new))
            self.start = np.append(self.start, self.start[-1] + np.cumsum(sizes))
            self.ids = np.append(self.ids, ids)
            self.known = pa.concat_arrays([self.known, new])
        return number[np.asarray(table.indices)]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        # Words alone need neither the normalizer nor the word pattern.
        self.words = Tokenizer(self.full.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith(WORD_END)
        self.simple = _Parts(self._encode_words)
        self.other = _Parts(self._encode_whole)

    def _encode_whole(self, parts: list[str]):
        found = [np.array(e.ids, np.uint32) for e in self.full.encode_batch(parts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _encode_words(self, parts: list[str]):
        lines = [" ".join(parts[i : i + 500]) for i in range(0, len(parts), 500)]
        found = self.words.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(parts):
            return self._encode_whole(parts)
        return ids, np.diff(last, prepend=-1)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column and where each text's ids start (end last)."""
        pieces = pc.ascii_split_whitespace(text.cast(pa.large_string()).fill_null(""))
        bounds = np.asarray(pieces.offsets)
        table = pieces.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        distinct = table.dictionary
        if not len(distinct):
            return np.zeros(0, np.uint32), np.zeros(len(text) + 1, np.int64)
        split = pc.extract_regex(pc.utf8_lower(distinct), SIMPLE)
        simple = np.asarray(split.is_valid())
        # utf8_lower may also turn other letters into plain ones (the Kelvin sign).
        simple &= np.asarray(pc.match_substring_regex(distinct, r"^[A-Za-zÀ-ÖØ-öø-ÿ]"))
        simple &= ~np.asarray(pc.match_substring_regex(distinct, r"[^ -~À-ÖØ-öø-ÿ]"))
        starts = np.zeros((len(distinct), 2), np.int64)
        sizes = np.zeros((len(distinct), 2), np.int64)
        mask = pa.array(simple)
        if simple.any():
            halves = split.filter(mask)
            number = self.simple.find(pa.concat_arrays([halves.field("w"), halves.field("p")])).reshape(2, -1).T
            starts[simple] = self.simple.start[number]
            sizes[simple] = self.simple.start[number + 1] - self.simple.start[number]
        if not simple.all():
            number = self.other.find(distinct.filter(pc.invert(mask)))
            starts[~simple, 0] = self.other.start[number] + len(self.simple.ids)
            sizes[~simple, 0] = self.other.start[number + 1] - self.other.start[number]
        # First the ids of every distinct piece, then of every piece in text order.
        ids, _ = _gather(np.concatenate([self.simple.ids, self.other.ids]), starts.ravel(), sizes.ravel())
        sizes = sizes.sum(axis=1, dtype=np.int32)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        at = np.asarray(table.indices)
        ids, total = _gather(ids, starts[at], sizes[at])
        return ids, total[bounds]


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Stretches of ``ids`` one after another, and where each starts in the result."""
    total = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    kind = np.int32 if max(total[-1], len(ids)) < 1 << 31 else np.int64
    take = np.repeat((starts - total[:-1]).astype(kind), sizes)
    take += np.arange(total[-1], dtype=kind)
    return ids[take], total


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)


def encoded(frames, path: str, limit: int = 6 << 20):
    """Yields ``(rows, ids, starts)`` for slices of the batches; column ``text``."""
    own = encoder(path)
    for rows, _, _ in batches(frames, "text", limit):
        ids, starts = own.encode(rows.column(rows.schema.get_field_index("text")))
        yield rows, ids, starts
    # A worker may serve another operator next; what this one needed goes back.
    pa.default_memory_pool().release_unused()
