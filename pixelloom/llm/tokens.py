"""Encoding with a tokenizer file of the ``tokenizers`` library, inside Arrow functions.

Byte-level BPE never merges across the pieces of its split pattern, so ids of a text
are the ids of its pieces in a row. Natural text repeats its pieces: the worker
encodes each new piece once with the library and joins cached bytes for the rest.
Texts with characters on whose class two Unicode versions might disagree go to the
library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np

from pixelloom.llm.textnum import trim

END_ID = 2
#: Split pattern of the byte-level BPE files, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SETTLED = "\t\n\r -~¡-¬®-ɏΑ-ΡΣ-ωА-яぁ-ゖァ-ヺ一-龥"
#: Latin text, whose letters a character class of the faster ``re`` module can name.
LATIN = "\t\n\r -~¡-©«¬®-±´¶-¸»¿-ſ"
LATIN_PATTERN = r" ?[A-Za-zÀ-ÖØ-öø-ſ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ſ]+|\s+(?!\S)|\s+"
#: Pieces a worker keeps (some 50 MB). Once full, the cache stays: frequent pieces came early.
CACHED = 300_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Both(dict):
    """Pieces of one call over those of the cache."""

    def __init__(self, known: dict, passing: dict):
        super().__init__(passing)
        self.known = known

    def __missing__(self, piece):
        return self.known[piece]


class Encoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Pieces are split already, so they need the same model without the pattern. Some hundred
        # go in one call, between special tokens, whose characters never make one piece.
        self.unsplit = Tokenizer.from_file(path)
        self.unsplit.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.mark = next(t.content for _, t in sorted(self.unsplit.get_added_tokens_decoder().items()) if t.special)
        self.mark_id = self.unsplit.token_to_id(self.mark)
        self.split = regex.compile(PATTERN).findall
        self.settled = regex.compile(f"[{SETTLED}]*+").fullmatch
        self.latin = re.compile(f"[{LATIN}]*+").fullmatch
        self.split_latin = re.compile(LATIN_PATTERN).findall
        self.pieces: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_pieces(self, pieces: list[str], together: int = 100) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(pieces), together):
            text = self.mark.join(pieces[k : k + together])
            ids = np.array(self.unsplit.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at, raw = np.flatnonzero(ids == self.mark_id), ids.tobytes()
            starts, ends = (np.r_[0, at + 1] * 4).tolist(), (np.r_[at, len(ids)] * 4).tolist()
            out += [raw[a:b] for a, b in zip(starts, ends)]
        return out

    def _by_pieces(self, cut: list[list[str]]) -> list[bytes]:
        """Ids of texts that are cut into pieces, by cached pieces."""
        known = self.pieces
        new = list(set(chain.from_iterable(cut)).difference(known))
        full = len(known) + len(new) > CACHED
        passing: dict[str, bytes] = {}
        (passing if full else known).update(zip(new, self._new_pieces(new)))
        get = _Both(known, passing).__getitem__ if full else known.__getitem__
        return [b"".join(map(get, p)) for p in cut]

    def encode(self, texts: list[str | None], group_chars: int = 1 << 20) -> list[np.ndarray]:
        """Ids of each text (null: empty) with the end id appended, as little-endian uint32."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= group_chars:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        end = array("I", [END_ID]).tobytes()
        cut, at, whole = [], [], []
        for k, t in enumerate(texts):
            split = self.split_latin if self.latin(t) else self.split if self.settled(t) else None
            if split is None:
                whole.append(k)
            else:
                cut.append(split(t))
                at.append(k)
        out: list[np.ndarray] = [None] * len(texts)
        for k, raw in zip(at + whole, self._by_pieces(cut) + self._whole([texts[k] for k in whole])):
            out[k] = np.frombuffer(raw + end, "<u4")
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def text_slices(batch, rows: int = 500):
    """Parts of an Arrow batch of (doc_id, text), as (ids, texts) lists."""
    for k in range(0, batch.num_rows, rows):
        part = batch.slice(k, rows)
        yield part.column(0), part.column(1).to_pylist()
    trim()  # a worker that waits for its next task holds no freed memory


def release() -> None:
    """Drop the worker's encoders and their pieces; operators that need the memory call this first."""
    encoder.cache_clear()
