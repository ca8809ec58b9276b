"""Public tokenizer files, loaded once a worker, with bounded caches of what they make of words."""

from __future__ import annotations

import base64
import json
import re
from array import array

import numpy as np

#: Most entries of a worker's cache; a full cache is emptied, results stay the same.
CACHE_ENTRIES, PIECE_ENTRIES = 300_000, 120_000
_LOADED: dict = {}
_PAIR_OF_SPACES = re.compile(r"\s\s")


def path_of(file: str, folder: str | None = None) -> str:
    """Where a vocabulary file lies: in `folder`, else where the installed package of public tokenizers has it."""
    if folder:
        return f"{folder}/{file}"
    import public_tokenizers

    return public_tokenizers.path(file)


def special_tokens(file: str, folder: str | None = None) -> dict[str, int]:
    """The special tokens that a tokenizer's `.json` file lists, and their ids."""
    with open(path_of(file, folder), encoding="utf-8") as source:
        return {t["content"]: t["id"] for t in json.load(source)["added_tokens"] if t["special"]}


class ByteBpe:
    """Byte-level BPE ids of whole texts as little-endian uint32 bytes.

    The `.json` file and the `.tiktoken` ranks hold the same vocabulary and give the same ids; the ranks are read
    by the faster library. Its pattern starts a new piece at each single blank between two characters that aren't
    white space, so such stretches are encoded apart and kept; a text with a run of white space is encoded whole. The
    strings of the `.json` file's special tokens become those tokens' ids, as the tokenizer's plain call gives them.
    """

    def __init__(self, file: str = "byte_bpe_50k.json", folder: str | None = None):
        import public_tokenizers
        import tiktoken

        ranks_file = file.removesuffix(".json").removesuffix(".tiktoken") + ".tiktoken"
        with open(path_of(ranks_file, folder), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding(ranks_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.coder._core_bpe.encode_ordinary
        self.starts = np.array([self.coder.decode_single_token_bytes(i).startswith(b" ") for i in range(self.coder.n_vocab)])
        self.kept: dict[str, bytes] = {}
        self.special = special_tokens(file, folder) if file.endswith(".json") else {}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def learn(self, words: set[str]) -> None:
        """Encode words without white space, each after a blank, where they aren't kept yet. A full cache is emptied first."""
        new = [w for w in words if w not in self.kept]
        if len(self.kept) + len(new) > CACHE_ENTRIES:
            self.kept.clear()
            new = list(words)
        for i in range(0, len(new), 2_000):
            part = new[i : i + 2_000]
            ids = np.array(self.encode(" " + " ".join(part)), "<u4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(part):
                raw, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                self.kept.update({w: raw[x:y] for w, x, y in zip(part, at, at[1:])})
            else:
                self.kept.update({w: array("I", self.encode(" " + w)).tobytes() for w in part})

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text of a batch."""
        if self.marks:
            apart = [self.marks.split(text) if self.marks.search(text) else None for text in texts]
            if any(apart):  # texts between special tokens are encoded each by itself
                plain = iter(self._plain([t for text, parts in zip(texts, apart, strict=True) for t in (parts[::2] if parts else [text])]))
                return [b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else next(plain) for k, p in enumerate(parts)) if parts else next(plain) for parts in apart]
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> list[bytes]:
        """ids_of texts without special tokens."""
        out: list = [None] * len(texts)
        for i in range(0, len(texts), 200):
            split = {}
            for k, text in enumerate(texts[i : i + 200], i):
                if len(text) > 200_000 or _PAIR_OF_SPACES.search(text) or text[:1].isspace() or text[-1:].isspace():
                    out[k] = array("I", self.encode(text)).tobytes()
                else:
                    split[k] = text.split(" ")
            inner = set().union(*(words[1:] for words in split.values()))
            self.learn(inner)
            for k, words in split.items():
                out[k] = array("I", self.encode(words[0])).tobytes() + b"".join([self.kept[w] for w in words[1:]])
        return out


class Pieces:
    """Sentence-piece ids of words, how many of them are byte pieces, and how many byte-level BPE ids the word has after a blank."""

    def __init__(self, file: str = "piece_bpe_32k.model", bpe_file: str = "byte_bpe_50k.json", folder: str | None = None):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path_of(file, folder))
        size = self.coder.get_piece_size()
        self.is_byte = np.array([self.coder.is_byte(i) for i in range(size)])
        self.starts = np.array([self.coder.id_to_piece(i).startswith("\u2581") for i in range(size)])
        bpe = ByteBpe(bpe_file, folder)
        self.bpe = bpe.encode
        self.bpe_starts = bpe.starts
        self.kept: dict[bytes, tuple[bytes, int, int]] = {}

    def learn(self, words: set[bytes]) -> None:
        """Encode those words that aren't kept yet. A full cache is emptied first.

        Neither vocabulary has a token that goes on after a blank, so many words are encoded in one call and cut apart
        where a token begins with one; words that a vocabulary's normaliser splits or joins are encoded one by one.
        """
        new = [w for w in words if w not in self.kept]
        if len(self.kept) + len(new) > PIECE_ENTRIES:
            self.kept.clear()
            new = list(words)
        for i in range(0, len(new), 2_000):
            part = new[i : i + 2_000]
            text = " ".join([w.decode("utf-8", "replace") for w in part])
            ids = np.array(self.coder.encode(text), np.uint32)
            at = np.flatnonzero(self.starts[ids])
            other = np.array(self.bpe(" " + text), np.int64)
            other_at = np.flatnonzero(self.bpe_starts[other])
            if len(part) == len(at) == len(other_at) and at[0] == 0 == other_at[0]:
                ends = [*at[1:].tolist(), len(ids)]
                held = np.add.reduceat(self.is_byte[ids].view(np.uint8), at, dtype=np.int64).tolist()
                raw = ids.tobytes()
                for w, a, b, n, m in zip(part, at.tolist(), ends, held, np.diff([*other_at, len(other)]).tolist(), strict=True):
                    self.kept[w] = (raw[4 * a : 4 * b], n, m)
            else:
                for w in part:
                    one = w.decode("utf-8", "replace")
                    ids = np.array(self.coder.encode(one), np.uint32)
                    self.kept[w] = (ids.tobytes(), int(self.is_byte[ids].sum()), len(self.bpe(" " + one)))


def loaded(kind: type, *args):
    """One object of `kind` for each worker process."""
    key = (kind, *args)
    if key not in _LOADED:
        _LOADED[key] = kind(*args)
    return _LOADED[key]
