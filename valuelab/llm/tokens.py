"""Token ids of whole texts by the vocabularies of public tokenizers."""

from __future__ import annotations

import os
import re
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the tokenizers' own patterns (the Unicode property).
_WS = "\\t-\\r \x85\xa0  -     　"
#: How byte-level BPE cuts a text before it merges.
BYTE_LEVEL_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _special(tokenizer) -> re.Pattern:
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, added)) or r"(?!)")


class ByteEncoder:
    """Ids of a byte-level BPE file of the tokenizers library.

    In such a file a merge's rank is its token's id, so the file's own vocabulary, read by the
    library, is all that tiktoken's merge loop needs; the ids are the same and take a fifth of
    the time.  A text that holds a special token's string goes to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.tokenizer = _library(path)
        self.special = _special(self.tokenizer)
        byte_of = _byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}
        self.fast = tiktoken.Encoding(
            "bytes", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, text: str) -> np.ndarray:
        if not self.special.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
            except ValueError:
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones are
    themselves, the others follow from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in shown]
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of a tokenizer that drops white space, so that each word has ids of its own.

    Words are encoded by the tokenizers library, each distinct word once for as long as it is
    kept: up to ``most`` words, the first seen stay.  New words go to the library many at a time,
    with a mark between them that is a word of one id.  A text that holds a special token's
    string, or a control character that Python takes for a space, is encoded as a whole.
    """

    MARK = "~"
    #: Words that go to the library together.
    TOGETHER = 200

    def __init__(self, path: str, most: int = 500_000):
        self.tokenizer = _library(path)
        self.special = re.compile(_special(self.tokenizer).pattern + "|[\x1c-\x1f]")
        #: Beyond Latin-1 lower case may depend on marks that follow, so it is left to the library.
        self.beyond = r"[^\x{00}-\x{ff}]"
        self.most = most
        self.words = pa.array([], pa.string())
        self.mark = self.encode(self.MARK)
        self.apart = re.compile(f"[{self.MARK}]|[^\x00-\xff]")
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids of all of them in a row.

        Words that hold the mark, or characters beyond Latin-1, are not joined with others.
        """
        alone = {i for i, w in enumerate(words) if self.apart.search(w)} if len(self.mark) == 1 else set(range(len(words)))
        joined = [w for i, w in enumerate(words) if i not in alone] if alone else words
        between = f" {self.MARK} "
        texts = [between.join(joined[i : i + self.TOGETHER]) for i in range(0, len(joined), self.TOGETHER)]
        parts = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.append(p, self.mark).astype(np.uint32) for p in parts]) if parts else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == self.mark[0]) if parts else np.zeros(0, np.int64)
        sizes = np.diff(ends, prepend=-1) - 1
        if len(sizes) != len(joined):  # the mark is not a word of its own here
            return self.encode_apart(words)
        flat = ids[ids != self.mark[0]] if parts else ids
        if not alone:
            return sizes, flat
        own_sizes, own = self.encode_apart([words[i] for i in sorted(alone)])
        places = np.argsort(np.r_[[i for i in range(len(words)) if i not in alone], sorted(alone)].astype(np.int64))
        sizes, flat = np.concatenate([sizes, own_sizes]), np.concatenate([flat, own])
        starts = (np.cumsum(sizes) - sizes)[places]
        sizes = sizes[places]
        ends = np.cumsum(sizes)
        return sizes, flat[np.repeat(starts - ends + sizes, sizes) + np.arange(len(flat))]

    def encode_apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode_words`, each word by itself."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        sizes, ids = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text (null: none), and the ids of all of them in a row.

        Arrow lower-cases, splits and numbers the words, so what Python touches is each distinct
        word of the column once.
        """
        texts = texts.fill_null("")
        if pc.any(pc.match_substring_regex(texts, self.special.pattern)).as_py():
            own = [
                np.array(self.encode(t), np.uint32)
                if self.special.search(t)
                else self.encode_column(pa.array([t], pa.string()))[1]
                for t in texts.to_pylist()
            ]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            return sizes, np.concatenate([*own, np.zeros(0, np.uint32)])
        beyond = pc.match_substring_regex(texts, self.beyond)
        lists = pc.utf8_split_whitespace(pc.if_else(beyond, texts, pc.utf8_lower(texts)))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missed = np.flatnonzero(at < 0)
        start, size, flat = self.start, self.size, self.flat
        if len(missed):
            new = words.take(pa.array(missed))
            sizes, ids = self.encode_words(new.to_pylist())
            at[missed] = np.arange(len(size), len(size) + len(new))
            start = np.concatenate([start, len(flat) + np.cumsum(sizes) - sizes])
            size = np.concatenate([size, sizes])
            flat = np.concatenate([flat, ids])
            if len(self.words) < self.most:
                self.words = pa.concat_arrays([self.words, new])
                self.start, self.size, self.flat = start, size, flat
        place = at[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = size[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(start[place] - ends[:-1], sizes) + np.arange(ends[-1])]
        return np.diff(ends[bounds - bounds[0]]), ids


def kept(kind, path: str):
    """An encoder that stays in this worker process, for the tasks that follow."""
    held = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    name = f"{kind.__name__}:{path}"
    if name not in held:
        held[name] = kind(path)
    return held[name]
