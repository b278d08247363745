"""Token ids by a public tokenizer file, with pieces of text that come again encoded once per worker."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

# How a byte-level BPE file splits text before merging: fixed pattern of that family of tokenizers.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 1_000_000  # parts a worker keeps; past that it keeps those of the texts at hand, results are the same
TOGETHER = 1024  # new parts encoded in one call


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Merges never cross the pieces the file's own splitter makes, so each distinct part made of whole pieces is encoded
    once and its ids reused. A file with another splitter or a normalizer, and a text that holds one of the file's added tokens, go
    through the tokenizer whole.
    """

    def __init__(self, path: str):
        import json

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space"))
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 else 4
        self.pieces = regex.compile(PIECES)
        self.blanks = regex.compile(r" (?:\s|$)")
        self.after_space: dict[str, bytes] = {}  # ids of a space and the key
        self.alone: dict[str, bytes] = {}  # ids of the key as it stands
        self.spans = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # a byte-level token has one character per byte
        for token, i in self.tokenizer.get_vocab().items():
            self.spans[i] = len(token)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids, ``width`` bytes each, of every text."""
        ids, ends = self.flat(texts)
        raw, stops = ids.tobytes(), (ends * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def flat(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by ``end_id`` if given, and where each text ends.

        A text is a head, whose ids are looked up by themselves, and the parts a space goes before. Those are numbered by
        distinct value, so each value is looked up once however often it comes.
        """
        heads, rests = zip(*map(self.head, texts)) if texts else ((), ())
        lists = pc.split_pattern(pa.array(rests, pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.learn({w for h in heads if isinstance(h, list) for w in h}, words)
        alone, n = self.alone.__getitem__, len(texts)
        known += [b"".join(map(alone, h)) if isinstance(h, list) else self.plain([h])[0] for h in heads]
        known.append(b"" if end_id is None else np.array([end_id], f"<u{self.width}").tobytes())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        stops = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64) + 2)
        codes, edge = np.empty(stops[-1] if n else 0, np.int64), np.zeros(stops[-1] if n else 0, bool)
        firsts = np.concatenate(([0], stops[:-1])).astype(np.int64)[:n]
        edge[firsts] = edge[stops - 1] = True
        codes[~edge] = coded.indices.to_numpy(zero_copy_only=False)
        codes[firsts], codes[stops - 1] = len(words) + np.arange(n), len(known) - 1
        took = sizes[codes]
        ends = np.cumsum(took)
        shift = (np.cumsum(sizes) - sizes)[codes] - (ends - took)
        ids = np.frombuffer(b"".join(known), f"<u{self.width}")[np.arange(ends[-1] if n else 0) + np.repeat(shift, took)]
        return ids, ends[stops - 1]

    def head(self, text: str) -> tuple[list[str] | str, str | None]:
        """What of a text stands before its first space, as parts no piece spans, and the rest; None for no rest.

        Each part of the rest begins where a space is followed by a non-space. A text with other spaces is cut into its
        pieces; one the tokenizer has to see whole is given back as it is.
        """
        if not self.by_piece or (self.added and self.added.search(text)):
            return text, None
        if self.blanks.search(text):
            return self.pieces.findall(text), None
        first, space, rest = text.partition(" ")
        return [first] if first else [], rest if space else None

    def learn(self, alone: set[str], after: list[str]) -> list[bytes]:
        """Ids of ``after``; what is not known yet is encoded and remembered.

        Where that is too much to remember, only what is needed now is kept.
        """
        found = list(map(self.after_space.get, after))
        single, new = [w for w in alone if w not in self.alone], [i for i, x in enumerate(found) if x is None]
        if len(self.alone) + len(self.after_space) + len(single) + len(new) > REMEMBERED:
            self.alone = {w: self.alone[w] for w in alone if w in self.alone}
            self.after_space = {w: x for w, x in zip(after, found) if x is not None}
        self.alone.update(zip(single, self.plain(single)))
        for lo in range(0, len(new), TOGETHER):
            group = new[lo:lo + TOGETHER]
            words = [after[i] for i in group]
            for i, w, x in zip(group, words, self.together([" " + w for w in words])):
                found[i] = self.after_space[w] = x
        return found

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with a space and a non-space: encoded as one text, cut where their bytes end."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends, want = np.cumsum(self.spans[ids]), np.cumsum([len(w.encode()) for w in words])
        at = np.searchsorted(ends, want)
        if not len(ends) or ends[-1] != want[-1] or (ends[at] != want).any():
            return self.plain(words)
        raw, stops = ids.astype(f"<u{self.width}").tobytes(), ((at + 1) * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def plain(self, texts: list[str]) -> list[bytes]:
        """Each text through the tokenizer."""
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, kept between tasks."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
