"""Whole-text token ids from a file of the tokenizers library, with a cache of pieces.

Work is by columns: Arrow cuts the texts and numbers their distinct pieces, the cache gives each piece its place
in one array of ids, and the ids of the texts are gathered from there.

A text is cut at single spaces and each distinct piece is encoded by the library once while it stays in the
worker's cache. That gives the ids of the whole text, because both kinds of files that are supported never join across such a space:
byte-level BPE with the usual pattern puts a lone space in front of the piece that follows it, and word-end
BPE drops white space. Within a run of white space the pattern keeps what the cuts part in one token, so there
a cut is safe unless a token of the vocabulary has a space after its first byte. A text that holds the
characters of such a token is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import at_stage

#: Distinct pieces that a worker keeps (about 200 bytes each); then those that came in one call only go first.
CACHE_PIECES = 800_000
#: Pieces that one call of the library encodes as one text.
JOINED = 2_000
#: Where a word ends before a sign; and a piece of one word, or of a word and a run of signs; under the pattern of the word-end file. No letter here
#: changes its kind in lower case or composes with a neighbour.
BEFORE_SIGN = "([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,;:!?])"
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,;:!?]*")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def joined_spaces(vocabulary: dict[str, int]) -> re.Pattern[str] | None:
    """Matches each text in which some token of a byte-level vocabulary could lie across a cut before a space."""
    of, found = _byte_of(), set()
    for token in vocabulary:
        if "\u0120" in token[1:] and all(c in of for c in token):
            found.add(bytes(of[c] for c in token).decode(errors="ignore"))  # parts of characters at the ends are left out
    least = sorted(t for t in found if not any(o != t and o in t for o in found))
    return re.compile("|".join(map(re.escape, least))) if least else None


def gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[start : start + n] of each range in turn."""
    return flat[np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)]


class PieceEncoder:
    """Token ids of texts, for a tokenizer file by path."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        spec = self.lib.to_str()
        head = spec[: spec.index('"vocab"')]
        self.spaced = '"normalizer":null' in head and '"pre_tokenizer":{"type":"ByteLevel","add_prefix_space":false' in head and '"use_regex":true' in head
        self.dropped = '"end_of_word_suffix":"</w>"' in head and '"content":" "},{"type":"Lowercase"}' in head and '"behavior":"Removed","invert":true' in head
        self.joined, self.opens = None, np.empty(0, bool)
        if self.spaced:
            vocabulary = json.loads(spec)["model"]["vocab"]
            self.joined = joined_spaces(vocabulary)
            self.opens = np.zeros(self.lib.get_vocab_size(), bool)
            self.opens[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        self.closes = np.zeros(self.lib.get_vocab_size(), bool)
        if self.dropped:
            self.closes[[i for t, i in json.loads(spec)["model"]["vocab"].items() if t.endswith("</w>")]] = True
        self.special = sorted({t.content.lower() for t in self.lib.get_added_tokens_decoder().values()})
        self.forget()

    def forget(self) -> None:
        """Empties the cache: place of each piece (and of those that open a text), its ids, and the calls that asked for it."""
        self.place: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.flat, self.start = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.asked = np.empty(0, np.int64)

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and the number of each."""
        ids = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n

    def _spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like _raw for pieces that each follow a space: the library reads many as one text, where the tokens that start with a space tell them apart."""
        text = " " + " ".join(pieces)
        if not (self.joined and self.joined.search(text)):
            ids, _ = self._raw([text])
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(pieces) and at[0] == 0:
                return ids, np.diff(at, append=len(ids))
        return self._raw([" " + p for p in pieces])

    def _dropped(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like _raw; plain pieces are read as one text, where the tokens that end a word tell them apart."""
        plain = np.fromiter((PLAIN.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        one = [p for p, k in zip(pieces, plain.tolist(), strict=True) if k]
        ids, n = self._raw([p for p, k in zip(pieces, plain.tolist(), strict=True) if not k])
        out = np.zeros(len(pieces), np.int64)
        out[~plain] = n
        if not one:
            return ids, out
        more, _ = self._raw([" ".join(one)])
        words = np.cumsum(np.fromiter((1 + (p[-1] in ".,;:!?") for p in one), np.int64, len(one)))
        ends = np.flatnonzero(self.closes[more])
        if len(ends) != words[-1]:
            return self._raw(pieces)
        out[plain] = np.diff(ends[words - 1], prepend=-1)
        start = np.zeros(len(pieces), np.int64)
        start[~plain] = np.cumsum(n) - n
        start[plain] = len(ids) + np.cumsum(out[plain]) - out[plain]
        return gather(np.concatenate([ids, more]), start, out), out

    def _learn(self, known: dict[str, int], pieces: list[str], lead: bool) -> None:
        ids, n = [self.flat], []
        for k in range(0, len(pieces), JOINED):
            some = pieces[k : k + JOINED]
            a, b = self._spaced(some) if lead else self._dropped(some) if self.dropped else self._raw(some)
            ids.append(a)
            n.append(b)
        known.update(zip(pieces, range(len(self.start) - 1, len(self.start) - 1 + len(pieces)), strict=True))
        self.flat = np.concatenate(ids)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(n))])
        self.asked = np.concatenate([self.asked, np.zeros(len(pieces), np.int64)])

    def _places(self, known: dict[str, int], pieces: list[str], lead: bool) -> np.ndarray:
        at = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if (miss := np.flatnonzero(at < 0)).size:
            at[miss] = np.arange(len(miss)) + len(self.start) - 1
            self._learn(known, [pieces[k] for k in miss.tolist()], lead)
        self.asked[at] += 1
        return at

    def _trim(self) -> None:
        """Keeps half of the cache at most: the pieces that most calls have asked for."""
        size = np.diff(self.start)
        at = len(self.asked) - CACHE_PIECES // 2
        least = np.partition(self.asked, at)[at]
        keep = self.asked > least
        self.flat = gather(self.flat, self.start[:-1][keep], size[keep])
        self.start = np.concatenate([np.zeros(1, np.int64), np.cumsum(size[keep])])
        self.asked = self.asked[keep] // 2
        to = np.cumsum(keep) - 1
        self.place, self.first = ({p: int(to[k]) for p, k in known.items() if keep[k]} for known in (self.place, self.first))

    def _by_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place in the cache of each piece, and where the pieces of each text start."""
        if self.dropped:  # fewer distinct pieces: letters in lower case, signs by themselves
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), BEFORE_SIGN, r"\1 \2")
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        at = self._places(self.place, coded.dictionary.to_pylist(), self.spaced)[coded.indices.to_numpy()]
        if self.spaced:
            opening = cut.flatten().take(pa.array(offsets[:-1])).dictionary_encode()
            at[offsets[:-1]] = self._places(self.first, opening.dictionary.to_pylist(), False)[opening.indices.to_numpy()]
        return at, offsets[:-1] - offsets[0]

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts are not to be cut."""
        if not (self.spaced or self.dropped):
            return np.ones(len(texts), bool)
        if self.dropped:  # the lower case of a text may hold a special string that the text does not
            low, found = pc.ascii_lower(texts), np.zeros(len(texts), bool)
            for t in self.special:
                found |= pc.match_substring(low, t).to_numpy(zero_copy_only=False)
            return found
        if not self.joined:
            return np.zeros(len(texts), bool)
        return pc.match_substring_regex(texts, self.joined.pattern).to_numpy(zero_copy_only=False)

    def arrays(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) in turn, without added special tokens, and the number of each; their
        strings in a text are read as the library's default does. end: an id after each text."""
        whole = self._whole(texts)
        flat, start, n = np.empty(0, np.uint32), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        if (by := np.flatnonzero(~whole)).size:
            at, first = self._by_piece(texts.take(pa.array(by)) if whole.any() else texts)
            size = np.diff(self.start)[at]
            flat, n[by] = gather(self.flat, self.start[at], size), np.add.reduceat(size, first)
        if (by := np.flatnonzero(whole)).size:
            ids, n[by] = self._raw(texts.take(pa.array(by)).to_pylist())
            start[by] = len(flat) + np.cumsum(n[by]) - n[by]
            flat = np.concatenate([flat, ids])
        by = ~whole
        start[by] = np.cumsum(n[by]) - n[by]
        if whole.any():
            flat = gather(flat, start, n)
        if len(self.place) > CACHE_PIECES:
            self._trim()
        if end is None:
            return flat, n
        out = np.full(len(flat) + len(n), end, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
        return out, n + 1

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        whole = self._whole(texts)
        n = np.zeros(len(texts), np.int64)
        if (by := np.flatnonzero(~whole)).size:
            at, first = self._by_piece(texts.take(pa.array(by)) if whole.any() else texts)
            n[by] = np.add.reduceat(np.diff(self.start)[at], first)
        if (by := np.flatnonzero(whole)).size:
            n[by] = self._raw(texts.take(pa.array(by)).to_pylist())[1]
        if len(self.place) > CACHE_PIECES:
            self._trim()
        return n

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        out = []
        for some in slices(pa.array(texts, pa.string())):
            flat, n = self.arrays(some)
            raw, ends = flat.astype("<u4").tobytes(), np.cumsum(n)
            out += [raw[4 * a : 4 * b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
        return out


_OPEN: dict[str, PieceEncoder] = {}
_STAGE = [-1]


def _give_back(stage: int) -> None:
    if stage != _STAGE[0]:
        _OPEN.clear()
        _STAGE[0] = stage


at_stage(_give_back)


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker and file; it outlives a task, but not its stage."""
    if path not in _OPEN:
        _OPEN[path] = PieceEncoder(path)
    return _OPEN[path]


def slices(texts: pa.Array, limit: int = 8 << 20) -> Iterator[pa.Array]:
    """texts in runs of about limit bytes, null as empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield texts.slice(first, last - first)
        first = last
