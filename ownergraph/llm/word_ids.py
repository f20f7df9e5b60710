"""Token ids of whole texts by the ``tokenizers`` library, word by word.

The vocabulary drops white space between pre-tokens, so a text's ids are the
ids of its white-space-separated words put together. Words that may hold a special
string, which matches in its own case only, are left as they are. Each Python worker asks the
library once for a word it has not seen lately and keeps its ids as bytes. Letters
a-z alone pass the library's normaliser and pre-tokenizer unchanged (looked up when it
is loaded): such words are given to its model.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

MARK = b"<|"  # the special strings begin so
SPACE = "[ \t-\r]+"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TAIL = string.punctuation.encode()
TOGETHER = 200  # words of letters that the library gets in one call
REMEMBER = 500_000  # words per worker; a full table keeps only the words in use


def _split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words before each text, number of each word, the distinct words)."""
    try:
        column = pa.array(texts, pa.large_string())
    except UnicodeEncodeError:
        column = pa.array([(t or "").encode("utf-8", "replace").decode() for t in texts], pa.large_string())
    column = column.fill_null("")
    # Lower case of A-Z only; the library's own rule does the others.
    lower = pc.ascii_lower(column)
    marked = pc.match_substring(column, MARK.decode())
    if pc.any(marked).as_py():
        apart = [" ".join(w if MARK.decode() in w else w.translate(LOWER) for w in re.split(SPACE, t)) for t in column.filter(marked).to_pylist()]
        lower = pc.replace_with_mask(lower, marked, pa.array(apart, pa.large_string()))
    words = pc.ascii_split_whitespace(lower)
    found = words.values.dictionary_encode()
    return words.offsets.to_numpy(), found.indices.to_numpy(), found.dictionary.cast(pa.large_binary()).to_pylist()


class WordIds:
    def __init__(self, path: str) -> None:
        self.lib = Tokenizer.from_file(path)
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[bytes, bytes] = {b"": b""}
        self.plain: dict[str, bool] = {}  # letters whose lower case ends with a letter
        self.ends = np.zeros(size, dtype=bool)  # ids that close a word
        for token, i in self.lib.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.raw = [self.pack([i]) for i in range(size)]
        self.model = self.lib.model if self._keeps(string.ascii_lowercase) else None

    def _keeps(self, letters: str) -> bool:
        """Whether words of ``letters`` come to the model as they are."""
        normalise, split = self.lib.normalizer, self.lib.pre_tokenizer
        for word in (letters, letters[::-1], *letters):
            if normalise and normalise.normalize_str(word) != word:
                return False
            if not split or [piece for piece, _ in split.pre_tokenize_str(word)] != [word]:
                return False
        return True

    def pack(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _ends_with_letter(self, letter: str) -> bool:
        if letter.isascii():
            return True
        if letter not in self.plain:
            lower = self.lib.normalizer.normalize_str(letter) if self.lib.normalizer else letter
            self.plain[letter] = bool(lower) and lower[-1].isalpha()
        return self.plain[letter]

    def _learn(self, words: list[bytes]) -> None:
        """Words of a-z go to the model. Other words of letters are encoded together:
        each ends with an id that closes a word, where the ids are cut. Others are
        given apart; of a word before ASCII punctuation only the core is new to the
        library, unless the library's lower case of the core ends with something
        else than a letter (of a dotted capital I it ends with a mark, which takes the
        ``.`` along)."""
        known = self.known
        cores, rest, others = {}, [], {}
        for w in words:
            core = w.rstrip(TAIL)
            if MARK in w:
                others[w] = w.decode("utf-8", "replace")
                continue
            if not core.isalpha():  # letters a-z
                text = core.decode("utf-8", "replace")
                if not text.isalpha() or (len(core) < len(w) and not self._ends_with_letter(text[-1])):
                    others[w] = w.decode("utf-8", "replace")
                    continue
            if len(core) < len(w):
                rest.append((w, core, w[len(core) :]))
            if core not in known and core not in cores:
                cores[core] = core.decode("utf-8", "replace")
        if self.model:
            tokenize, raw = self.model.tokenize, self.raw
            for w, text in cores.items():
                if text.isascii():
                    known[w] = b"".join([raw[t.id] for t in tokenize(text)])
            cores = {w: text for w, text in cores.items() if not text.isascii()}
        for _, _, mark in rest:
            if mark not in known:
                others[mark] = mark.decode()
        if others:
            # Given apart, in one call: each word is encoded for itself, as alone.
            found = self.lib.encode(list(others.values()), is_pretokenized=True, add_special_tokens=False)
            raw, size = self.pack(found.ids), self.dtype.itemsize
            bounds = np.searchsorted(np.asarray(found.word_ids, dtype=np.int64), np.arange(len(others) + 1)) * size
            for w, start, end in zip(others, bounds.tolist(), bounds[1:].tolist()):
                known[w] = raw[start:end]
        todo = list(cores.items())
        for i in range(0, len(todo), TOGETHER):
            some = todo[i : i + TOGETHER]
            ids = np.array(self.lib.encode(" ".join([text for _, text in some]), add_special_tokens=False).ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, size, start = ids.tobytes(), self.dtype.itemsize, 0
                for (w, _), cut in zip(some, cuts.tolist()):
                    known[w] = raw[start * size : cut * size]
                    start = cut
            else:
                for w, text in some:
                    known[w] = self.pack(self.lib.encode(text, add_special_tokens=False).ids)
        for w, core, mark in rest:
            known[w] = known[core] + known[mark]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text the ids as little-endian unsigned integers of ``dtype``."""
        offsets, at, words = _split(texts)
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) + len(new) > REMEMBER:
                self.known = known = {w: known[w] for w in words if w in known}
                known[b""] = b""
            self._learn(new)
        ids = [known[w] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        # The ids of all texts one after the other, taken from those of the distinct words.
        long = sizes[at]
        ends = np.cumsum(long)
        flat = np.frombuffer(b"".join(ids), self.dtype)[np.repeat(starts[at] - ends + long, long) + np.arange(long.sum())]
        raw, bounds = flat.tobytes(), np.concatenate([[0], ends])[offsets] * self.dtype.itemsize
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
