"""Token ids of whole texts, with the tokenizers library, memoised by pre-token."""

from __future__ import annotations

import os
import re

import numpy as np

#: A text of these characters only is cut into pre-tokens here; any other text goes to the tokenizer whole.
_OTHER = re.compile(r"[^ -~\n¡-©«-±´¶-¸»¿-ÿ]")
#: The pre-tokens of byte-level BPE for such texts: letters, digits, contractions (before signs), signs, white space.
_PIECE = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?[^ \nA-Za-z0-9À-ÖØ-öø-ÿ]+|[ \n]+(?![^ \n])|[ \n]+"
)
#: Pre-tokens of a generation of the memory: when it is full it becomes the old one, and what is still used moves on.
MEMO = 300_000
#: New pre-tokens that one text of a call to the library holds.
CALL = 100
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: the byte's own where it can be printed, else the next one above U+0100."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printed)
    return {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(others)}


#: Stands between cut pre-tokens; no text that is cut here holds it, and no byte has it as its letter.
_BETWEEN = "\r"
_LETTERS = _byte_letters() | {ord(_BETWEEN): _BETWEEN}


class _Memo(dict):
    """Numbers of pre-tokens. One that is asked for the first time gets the next number and stands in `new` until its ids are known; `old` is the generation before."""

    def __init__(self, old: dict[str, int], known: int) -> None:
        self.old, self.known, self.new = old, known, []

    def __missing__(self, piece: str) -> int:
        at = self.old.get(piece)
        if at is None:
            at = self.known + len(self.new)
            self.new.append(piece)
        self[piece] = at
        return at


def _gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at starts, one behind the other."""
    ends = np.cumsum(lengths)
    return ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in
    order; each distinct pre-token is merged once and remembered. Those that a batch of texts asks
    for the first time are merged by one call of the library. Added tokens (<|endoftext|>)
    are read as such, by the library from whole texts.
    """

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(file)
        #: A text that holds one of these goes to the tokenizer whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: The same merges for pre-tokens that are cut already.
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = CharDelimiterSplit(_BETWEEN)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.letters = np.zeros(1 + max(vocabulary.values()), np.int64)
        self.letters[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.memo = _Memo({}, 0)
        #: Of each number: where its ids begin, and how many they are.
        self.ids, self.starts, self.lengths = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _turn(self) -> None:
        """Begin a generation, once the present one is full: the ids of the one before it are dropped."""
        if len(self.memo) <= MEMO:
            return
        kept = np.fromiter(self.memo.values(), np.int64, len(self.memo))
        self.ids, self.lengths = _gather(self.ids, self.starts[kept], self.lengths[kept]), self.lengths[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.memo = _Memo(dict(zip(self.memo, range(len(kept)), strict=True)), len(kept))

    def _merge(self) -> None:
        """Learn the ids of the pre-tokens that are new."""
        new = self.memo.new
        if not new:
            return
        cut = _BETWEEN.join(new).encode().decode("latin-1").translate(_LETTERS).split(_BETWEEN)
        calls = [_BETWEEN.join(cut[i : i + CALL]) for i in range(0, len(cut), CALL)]
        ids = np.concatenate([np.asarray(x.ids, "<u4") for x in self.merger.encode_batch_fast(calls, add_special_tokens=False)])
        # No id reaches over the end of a pre-token, so the letters that the ids stand for tell where each ends.
        ends = 1 + np.searchsorted(np.cumsum(self.letters[ids]), np.cumsum([len(x) for x in cut]))
        lengths = np.diff(ends, prepend=0)
        self.starts = np.concatenate([self.starts, len(self.ids) + ends - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        self.memo.known, self.memo.new = self.memo.known + len(new), []

    def encode(self, texts: list[str]) -> list[bytes]:
        self._turn()
        number = self.memo.__getitem__
        out: list[bytes | None] = [self._whole(t) if _OTHER.search(t) or any(x in t for x in self.added) else None for t in texts]
        plain = [i for i, whole in enumerate(out) if whole is None]
        pieces = [np.fromiter(map(number, _PIECE.findall(texts[i])), np.int64) for i in plain]
        self._merge()
        for i, numbers in zip(plain, pieces, strict=True):
            out[i] = _gather(self.ids, self.starts[numbers], self.lengths[numbers]).tobytes()
        return out


def encoder(file: str) -> Encoder:
    """One encoder a file and worker process, kept between tasks; its ids are those of the library's own call."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
