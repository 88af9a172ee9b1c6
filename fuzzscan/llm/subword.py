"""Whole texts to ids, each distinct word once: by the tokenizers library here, by merges of our own in bpe."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: A worker remembers the ids of so many words (about 50 bytes each); the most frequent ones stay.
MEMO = 1_000_000
#: Words that the library gets as one text (it is quickest on texts of about 2 KB), and characters of a text that are
#: split at once.
TOGETHER, SPAN = 200, 1 << 20
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of each run, in a row."""
    ends = np.cumsum(sizes)
    out = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


class WordEncoder:
    """Encodes by words. A byte-level pre-tokenizer never crosses a space that stands between two characters which are no
    white space, so a text is split there; each distinct word, with its space, is looked up or learned, and texts with
    other spaces are encoded whole. So are texts that hold an added token of the vocabulary, which may cross spaces. Results
    equal those of encoding whole texts. What is known lies in arrays: the words, where the ids of each start, how many
    there are (-1 for a word whose space is not safe), and how often each was met. Subclasses say how to encode."""

    #: Bytes of text that each id stands for.
    lengths: np.ndarray

    def __init__(self, dtype: np.dtype, remembered: int | None = None, added: tuple[str, ...] = ()):
        self.dtype, self.remembered, self.added = dtype, MEMO if remembered is None else remembered, added
        self.known, self.hits = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, encoded as it is."""
        raise NotImplementedError

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word with a space before it, in a row, and the number of each word's; no word is empty or has
        white space at either end. Many go through together, and are cut where the bytes of ids meet spaces."""
        texts = [" " + " ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        ids = np.frombuffer(b"".join(self.whole(texts)), self.dtype)
        flat = np.frombuffer("".join(texts).encode(), np.uint8)
        ends = np.append(np.flatnonzero(flat == 32)[1:], len(flat))
        token_ends = np.cumsum(self.lengths[ids])
        cuts = np.searchsorted(token_ends, ends)
        if len(ends) == len(words) and len(ids) and token_ends[-1] == len(flat) and (token_ends[cuts] == ends).all():
            return ids, np.diff(cuts, prepend=-1)
        made = self.whole([" " + w for w in words])
        return np.frombuffer(b"".join(made), self.dtype), np.array([len(x) // self.dtype.itemsize for x in made], np.int64)

    def _learn(self, words: pa.Array) -> None:
        """Adds these words, none of which is known."""
        text, sizes = common.joined(words).decode(), np.full(len(words), -1, np.int64)
        new, bare = text.split(" "), text.split()
        if sum(map(len, bare)) + len(bare) - 1 != len(text):  # some word is empty, or begins or ends with white space
            safe = np.array([bool(w) and not w[0].isspace() and not w[-1].isspace() for w in new])
            new = [w for w, x in zip(new, safe.tolist()) if x]
        else:
            safe = np.ones(len(new), bool)
        ids = np.zeros(0, self.dtype)
        if new:
            ids, sizes[safe] = self.words(new)
        taken = np.maximum(sizes, 0)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(taken) - taken])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
        self.known, self.hits = pa.concat_arrays([self.known, words]), np.append(self.hits, np.zeros(len(words), np.int64))

    def _trim(self) -> None:
        """If too many words are known, the more frequent half of those allowed stays, with half their counts."""
        keep = self.remembered // 2
        if len(self.hits) <= self.remembered:
            return
        own = np.sort(np.argpartition(self.hits, len(self.hits) - keep)[len(self.hits) - keep :]) if keep else np.zeros(0, np.int64)
        sizes = self.sizes[own]
        taken = np.maximum(sizes, 0)
        self.flat = self.flat[_runs(self.starts[own], taken)]
        self.known, self.hits, self.sizes, self.starts = self.known.take(pa.array(own)), self.hits[own] // 2, sizes, np.cumsum(taken) - taken

    def spans(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SPAN:
            m = _SAFE.search(text, at + SPAN)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes of self.dtype; null and empty texts have none."""
        ids, lengths = self.encode_arrays(pa.array(texts, pa.string()))
        stops = np.cumsum(lengths)
        return [ids[a:b].tobytes() for a, b in zip((stops - lengths).tolist(), stops.tolist())]

    def encode_arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and the number of each text's."""
        filled = texts.fill_null("")
        special = np.zeros(len(filled), bool)
        for token in self.added:
            special |= pc.match_substring(filled, token).to_numpy(zero_copy_only=False).astype(bool)
        alone = np.flatnonzero(special | (pc.binary_length(filled).to_numpy(zero_copy_only=False) > 4 * SPAN))
        if not len(alone):
            return self._encode(filled)
        # a very long text goes through in spans of its own
        ids, lengths, at = [], [], 0
        for i in [*alone.tolist(), len(filled)]:
            made, n = self._encode(filled.slice(at, i - at))
            ids.append(made)
            lengths.append(n)
            if i < len(filled):
                text = filled[i].as_py()
                if special[i]:
                    parts = [np.frombuffer(x, self.dtype) for x in self.whole([text])]
                else:
                    parts = [self._encode(pa.array([x], pa.string()))[0] for x in self.spans(text)]
                ids += parts
                lengths.append(np.array([sum(map(len, parts))], np.int64))
            at = i + 1
        return np.concatenate(ids), np.concatenate(lengths)

    def encode_binary(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """The ids of each text as a binary column, with `end` behind each if it is given."""
        ids, lengths = self.encode_arrays(texts)
        if end is not None:
            ids, lengths = np.insert(ids, np.cumsum(lengths), end), lengths + 1
        stops = np.concatenate([[0], np.cumsum(lengths)]) * self.dtype.itemsize
        return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words are split and looked up by Arrow; each distinct one that is not known is learned once, and ids are gathered
        by number. The first word of each text has no space before it and is encoded as it is."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        words, first = split.flatten(), offsets[:-1]
        heads = words.take(pa.array(first)).to_pylist()
        codes = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        codes[first] = 0
        new = np.flatnonzero(codes < 0)
        if len(new):
            table = words.take(pa.array(new)).dictionary_encode()
            codes[new] = len(self.known) + table.indices.to_numpy()
            self._learn(table.dictionary)
        inner = np.ones(len(codes), bool)
        inner[first] = False
        self.hits += np.bincount(codes[inner], minlength=len(self.hits))
        codes[first] = len(self.sizes) + np.arange(len(heads))
        made = self.whole(heads)
        more = np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize
        starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(more) - more])
        sizes, flat = np.concatenate([self.sizes, more]), np.concatenate([self.flat, np.frombuffer(b"".join(made), self.dtype)])
        per_word = sizes[codes]
        odd = per_word < 0
        some = bool(odd.any())
        if some:
            per_word[odd] = 0
        ids = flat[_runs(starts[codes], per_word)]
        stops = np.cumsum(per_word)[offsets[1:] - 1]
        lengths = np.diff(np.concatenate([[0], stops]))
        self._trim()
        unsafe = np.array([h[-1:].isspace() for h in heads], bool)
        if some:
            unsafe |= np.add.reduceat(odd, first) > 0
        if not unsafe.any():
            return ids, lengths
        parts = np.split(ids, stops[:-1])
        at = np.flatnonzero(unsafe)
        for i, raw in zip(at.tolist(), self.whole([texts[i].as_py() for i in at.tolist()])):
            parts[i] = np.frombuffer(raw, self.dtype)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


class Subwords(WordEncoder):
    """Byte-level BPE of a tokenizers file, by the library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        added = tuple(sorted(x.content for x in self.library.get_added_tokens_decoder().values()))
        super().__init__(np.dtype("<u2" if self.size <= 1 << 16 else "<u4"), added=added)
        self.lengths = np.zeros(self.size, np.int64)
        for token, i in vocabulary.items():  # a byte of text is one character of a token
            self.lengths[i] = len(token)

    def tokens(self) -> list[bytes]:
        """The bytes of every id: byte-level tokens write each byte as one character of a fixed alphabet."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        out = [b""] * self.size
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            out[i] = bytes(chars.get(c, 63) for c in token)
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class RankIds(WordEncoder):
    """Byte-level BPE of a rank file, by the tiktoken library, for operators that need ids but not those of a tokenizers
    file. One id behind the ranks is free, for an end."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        super().__init__(np.dtype("<u2" if self.size <= 1 << 16 else "<u4"))
        self._tokens = [b""] * self.size
        for token, rank in ranks.items():
            self._tokens[rank] = token
        self.lengths = np.array(list(map(len, self._tokens)), np.int64)

    def tokens(self) -> list[bytes]:
        return self._tokens

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.library.encode_to_numpy(t, disallowed_special=()).astype(self.dtype).tobytes() for t in texts]


@lru_cache(maxsize=2)
def rank_ids(name: str) -> RankIds:
    """One for each Python worker."""
    return RankIds(common.tokenizer_file(name))


@lru_cache(maxsize=2)
def subwords(name: str) -> Subwords:
    """One for each Python worker."""
    return Subwords(common.tokenizer_file(name))
