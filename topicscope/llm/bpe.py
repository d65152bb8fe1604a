"""Token ids of whole texts with the ``tokenizers`` library, inside Python tasks.

The byte-level splitter never lets a token span a single space or newline that
stands between non-space characters, so such a text is the concatenation of
its words (each with its leading space).  Words repeat, so their ids are kept
in a bounded cache as little-endian bytes and a text becomes one ``join``.
Where white space touches white space the splitter takes the run up to its last
character as a piece (at the text's end, all of it): texts are cut there and the
runs have a cache of their own.  Texts that contain the string of an added
token of the file (one token there) go through the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

_TOUCHING = re.compile(r"\s\s")
_RUN = re.compile(r"(\s+(?=\s))")
_SPACE = re.compile(r"\s")
_ODD = re.compile("[\x1c-\x1f]")   # white space here, none for the tokenizer
#: The byte-level splitter's public pattern, for ASCII (where all libraries agree on the classes).
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_SIMPLE = re.compile(r"\n?[!-~]*")
_LOADED: dict[str, "ByteLevelEncoder"] = {}


def encoder(path: str) -> "ByteLevelEncoder":
    """One encoder per file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteLevelEncoder(path)
    return _LOADED[path]


def _model(path: str, tok):
    """The tokenizer's BPE model, without the library's own small word cache where the file sets nothing special."""
    from tokenizers.models import BPE

    with open(path, encoding="utf-8") as f:
        conf = json.load(f)["model"]
    if conf.get("type") != "BPE" or any(conf.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return tok.model
    return BPE(vocab=conf["vocab"], merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in conf["merges"]], cache_capacity=0)


class ByteLevelEncoder:
    """Ids as ``<u4`` bytes.

    ``max_words`` (about 200 bytes each) bounds the cache: the words of the last half are kept when it
    is full, and older ones return when they are used again.
    """

    def __init__(self, path: str, max_words: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # with white space in an added token a text's words cannot stand alone
        self.split = not any(_SPACE.search(t) for t in self.added)
        vocab = self.tok.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)   # ids of tokens that begin with a space
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.newline = int(self.ids("\n")[0])
        self.max_words = max_words
        self.model = _model(path, self.tok)
        self.bare: dict[str, bytes] = {}   # pieces that begin without a space
        # a key is a word after a space, or a newline and the word that begins the line
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")   # without offsets

    def plain(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def _learn(self, missing: set[str]) -> None:
        """Ids of unseen words: ASCII words by their pieces, the others in two calls (those after spaces, those after newlines)."""
        now, old, fresh = self.now, self.old, []
        if len(self.bare) > 200_000:
            self.bare = {}
        tokenize = self.model.tokenize
        for w in missing:
            got = old.get(w)
            if got is None:
                if w.isascii() and w.isalpha():
                    got = array("I", [t.id for t in tokenize("\u0120" + w)]).tobytes()
                elif _SIMPLE.fullmatch(w):
                    got = self._ascii(w)
                else:
                    fresh.append(w)
                    continue
            now[w] = got
        lines = [w for w in fresh if w[:1] == "\n"]
        words = [w for w in fresh if w[:1] != "\n"]
        if _SPACE.search("".join(words)):   # rare: tabs and the like inside a word
            for w in words:
                now[w] = self.plain(" " + w)
        elif words:
            ids = self.ids(" " + " ".join(words))
            self._cut(words, ids, np.flatnonzero(self.opens[ids]))
        if any(_SPACE.search(w, 1) for w in lines):
            for w in lines:
                now[w] = self.plain(w)
        elif lines:
            ids = self.ids("".join(lines))
            self._cut(lines, ids, np.flatnonzero(ids == self.newline))

    def _ascii(self, word: str) -> bytes:
        """Ids of a printable ASCII word after a space, or after the newline that it begins with."""
        out, now, bare = [], self.now, self.bare
        for p in _PIECES.findall(word if word[:1] == "\n" else " " + word):
            if p[0] == " ":       # kept as a word, without its space
                got = now.get(p[1:])
                if got is None:
                    got = now[p[1:]] = self._piece("\u0120" + p[1:])
            else:
                got = bare.get(p)
                if got is None:
                    got = bare[p] = self._piece("\u010a" if p == "\n" else p)
            out.append(got)
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece in the byte-level alphabet, which writes other letters for a space and a newline (fixed values)."""
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _cut(self, words: list[str], ids: np.ndarray, starts: np.ndarray) -> None:
        if len(starts) != len(words):
            raise ValueError("words and ids do not line up")
        raw, at = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
        now = self.now
        for i, w in enumerate(words):
            now[w] = raw[at[i]:at[i + 1]]

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None], chars: int = 1 << 18) -> Iterator[bytes]:
        """Ids of each text; unseen words of about ``chars`` characters of texts are learnt together."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(text)
            size += len(text or "")
            if size > chars:
                yield from self._together(waiting)
                waiting, size = [], 0
        yield from self._together(waiting)

    def _together(self, texts: list[str | None]) -> Iterator[bytes]:
        if len(self.now) > self.max_words // 2:
            self.now, self.old = {}, self.now
        get, missing = self.now.get, set()

        def look_up(text: str) -> tuple[list[str], list[bytes | None]]:
            """Words of a text in which no white space touches another, and their ids as far as they are known."""
            words = text.replace("\n", " \n").split(" ")
            words[0] = "\n" + words[0]   # the text's first word begins a line; its newline is cut off again
            ids = list(map(get, words))
            if None in ids:
                missing.update(w for w, i in zip(words, ids) if i is None)
            return words, ids

        found = [[look_up(p) if type(p) is str else p for p in self._pieces(text)] for text in texts]
        if missing:
            self._learn(missing)
        for pieces in found:
            yield b"".join([p if type(p) is bytes else self._join(*p) for p in pieces])

    def _pieces(self, text: str | None) -> list[str | bytes]:
        """The text cut into strings in which no white space touches another, and ids of all else."""
        if not text:
            return []
        if not self.split or text.isspace() or any(t in text for t in self.added):
            return [self.plain(text)]
        if not _TOUCHING.search(text):
            return [text]
        if _ODD.search(text):
            return [self.plain(text)]
        body = text.rstrip()
        parts = _RUN.split(body)   # words, run, words, run, ...
        return [*(self._run(p) if i % 2 else p for i, p in enumerate(parts) if p), self._run(text[len(body):])]

    def _join(self, words: list[str], ids: list[bytes | None]) -> bytes:
        if None in ids:
            now = self.now
            ids = [now[w] if i is None else i for w, i in zip(words, ids)]
        return b"".join(ids)[4:]

    def _run(self, space: str) -> bytes:
        """Ids of a run of white space that stands alone."""
        got = self.runs.get(space)
        if got is None:
            got = self.plain(space) if space else b""
            if len(space) <= 64 and len(self.runs) < 4096:
                self.runs[space] = got
        return got
