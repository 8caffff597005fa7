"""Token ids of whole texts by the tokenizers library, with a memo of words.

Byte-level tokenizers cut a text before every lone space and at every lone line
end, and word tokenizers drop white space, whatever stands around it. So a
text's ids are the ids of its words in order; a word seen before is looked up.
Of a new one, a run of letters and a run of signs after it are pieces of their
own, which go straight to the tokenizer's model; other words go through the
whole tokenizer, and texts with other white space or with a token that was added
to the vocabulary are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Words kept in a Python worker that came again, and as many pieces; of those that came once a quarter as many.
MEMO = 200_000
#: Letters whose lower case is one letter, then signs.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įıĴ-ɏ]+)([.,;:!?*$%&#|]*)")
_LOADED: dict[str, Encoder] = {}


def load(tokenizer: str) -> Encoder:
    """This process's encoder; tokenizer is a file's path or the name of a public tokenizer's file."""
    if tokenizer not in _LOADED:
        _LOADED[tokenizer] = Encoder(tokenizer)
    return _LOADED[tokenizer]


def unload() -> None:
    """Drops this process's encoders, some 140 MB each with full memos."""
    _LOADED.clear()


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: its own if it prints, else the next from 256 up."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in prints]
    return {b: chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}


class Encoder:
    def __init__(self, tokenizer: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not os.path.exists(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        steps = before.get("pretokenizers", [])
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        #: Words carry the space before them; or white space is dropped.
        self.led = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.free = "\\\\s+" in json.dumps(spec["normalizer"]) and [x.get("behavior") for x in steps][:1] == ["Removed"] and steps[-1].get("type") == "ByteLevel"
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.added_head = os.path.commonprefix(self.added)
        self.letters = byte_letters()
        self.space = self.letters[32]
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.limit = memo
        self.memo: dict[str, bytes] = {}
        self.once: set[str] = set()  # words of the memo that came in one call only
        self.pieces: dict[str, bytes] = {}
        self.line_end = self._whole("\n") if self.led else b""

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece in the letters of the vocabulary."""
        if len(self.pieces) >= self.limit:
            self.pieces.clear()
        ids = self.pieces[piece] = array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        """The ids of one word of `_split`."""
        before, lead = b"", ""
        if self.led:
            mark = word[:1]
            if mark == "\n":
                before, word = self.line_end, word[1:]
            elif mark == "\0":
                word = word[1:]
            else:
                lead = self.space
        head, signs = word, ""
        if not (word.isascii() and word.isalpha()):
            plain = _PLAIN.fullmatch(word)
            if not plain:
                return before + self._whole(" " + word if lead else word)
            head, signs = plain.groups()
        if self.lower:
            head = head.lower()
        if not head.isascii():
            head = head.encode().decode("latin-1").translate(self.letters)
        head = lead + head
        ids = self.pieces.get(head) or self._piece(head)
        if signs:
            ids += self.pieces.get(signs) or self._piece(signs)
        return before + ids if before else ids

    def _learn(self, words: set[str]) -> None:
        """Has the ids of all these words at hand: kept once a word comes in a second call, else for some calls."""
        again = words & self.once
        if len(self.memo) - len(self.once) + len(again) <= self.limit:
            self.once -= again
        new = words.difference(self.memo)
        if len(self.once) > self.limit // 4:
            for w in self.once - words:
                del self.memo[w]
            self.once &= words
        self.memo.update(zip(new, map(self._word, new)))
        self.once |= new

    def _split(self, text: str) -> list[str] | None:
        """The words of a text, or None where words don't stand for themselves.

        With a `led` tokenizer a word has its space before it, the first word
        begins with a zero character, and a line's first one with the line end.
        """
        if self.added_head in text and any(t in text for t in self.added):
            return None
        words = text.split()
        if self.free:
            return None if any(c in text for c in "\x1c\x1d\x1e\x1f") else words
        gaps = len(words) - 1
        if not words or "\0" in text or text.count(" ") + text.count("\n") != gaps or sum(map(len, words)) + gaps != len(text):
            return None if text else []
        return ("\0" + text).replace("\n", " \n").split(" ")

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text, as `dtype`; null is like an empty text."""
        if not (self.led or self.free):
            return [np.frombuffer(self._whole(t or ""), self.dtype) for t in texts]
        parts = [self._split(t or "") for t in texts]
        self._learn(set().union(*(p for p in parts if p)))
        found = self.memo.__getitem__
        return [np.frombuffer(self._whole(t) if p is None else b"".join(map(found, p)), self.dtype) for t, p in zip(texts, parts)]
