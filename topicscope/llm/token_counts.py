"""Token counts: a broadcast table of frequent pre-token lengths before worker caches.

A byte-level tokenizer cuts a text into pre-tokens and encodes each by itself,
so a text's count is the sum of its pre-tokens' counts.  Nothing is shuffled:

* Tier 1: the pre-tokens of a bounded sample of documents (``sample_rows``
  expected) are counted, and the counts of tokens of the ``table_words`` most
  frequent go to every worker as one compact table (a UTF-8 blob, offsets and
  16-bit counts).  The sample decides only the speed.
* Tier 2: a pre-token that the table lacks is encoded by the library once per
  worker; a cache of two generations bounds what is kept.

The pre-tokens are cut with the tokenizer's own public pattern.  Its Unicode
classes come from two libraries here, so the driver asks the tokenizer for the
class of every assigned character; a text that holds a character on which they
differ (or an unassigned one) is encoded whole by the library, as is every text
of a tokenizer that is not byte-level.  An added token's string counts as the
library counts it: the parts beside it are texts of their own.  Very long
texts pass in slices cut before a single space, where a pre-token always ends.

Defined results: a null or empty text has 0 bytes and 0 tokens and is not over
the limit; every input row gives one row, repeated rows and null ids too; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level splitter's public pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer pre-tokens are not kept in the table or in a cache.
LONGEST_KEPT = 64
#: Characters of a text that are cut into pre-tokens at once.
SLICE = 1 << 20

_PRE_TOKEN = regex.compile(PATTERN)
_SAFE_CUT = regex.compile(r"(?<=\S)(?= \S)")
_WORKER: dict[str, "PreTokenCounter"] = {}


def load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def is_byte_level(path: str) -> bool:
    """Plain byte-level BPE by the pattern, with added tokens that are cut out as they stand."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    pre, model = conf.get("pre_tokenizer") or {}, conf.get("model") or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in conf.get("added_tokens") or [])
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not conf.get("normalizer")
            and model.get("type") == "BPE" and not model.get("dropout") and plain)


def differing_characters(tok) -> np.ndarray:
    """Of every code point: whether the two libraries differ on its kind (letter, number, space, other), or it is unassigned."""
    codes = np.array([c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")], "i8")
    differ = np.ones(0x110000, bool)
    differ[codes] = False
    for probe, kind in (("a", r"a\p{L}"), ("1", r"1\p{N}"), ("!", r"![^\s\p{L}\p{N}]")):
        # a character joins the probe before it if it is of the probe's kind; a tab and a newline keep the probes apart
        for i in range(0, len(codes), 256):
            part = codes[i:i + 256]
            text = "".join(f"{probe}{chr(c)}\t\n" for c in part.tolist())
            ours, theirs = np.zeros(len(text), bool), np.ones(len(text), bool)
            ours[[m.start() for m in regex.finditer(kind, text)]] = True
            theirs[[at - 1 for _, (at, _) in tok.pre_tokenizer.pre_tokenize_str(text) if at]] = False
            differ[part] |= (ours != theirs)[::4]
    return differ


@dataclass
class Table:
    """The frequent pre-tokens, compactly: ``blob[ends[i-1]:ends[i]]`` has ``counts[i]`` tokens."""
    path: str
    key: str
    doubtful: bytes | None    # a bit a code point; None: the tokenizer is not byte-level, whole texts go to the library
    blob: bytes = b""
    ends: np.ndarray | None = None
    counts: np.ndarray | None = None

    def lengths(self) -> dict[str, int]:
        if self.ends is None:
            return {}
        at = [0, *self.ends.tolist()]
        return {self.blob[i:j].decode(): n for i, j, n in zip(at, at[1:], self.counts.tolist())}


class PreTokenCounter:
    """Counts of one worker process: the broadcast table, then a cache of at most ``max_words`` pre-tokens."""

    def __init__(self, table: Table, max_words: int = 400_000):
        self.tok = load(table.path)
        self.table = table.lengths()
        self.doubtful = None if table.doubtful is None else np.unpackbits(np.frombuffer(table.doubtful, "u1")).astype(bool)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.one_added = len(added) == 1
        self.max_words = max_words
        self.now: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.misses = 0

    def whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.doubtful is None or (not text.isascii() and self.doubtful[np.frombuffer(text.encode("utf-32-le"), "<u4")].any()):
            return self.whole(text)
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        if not self.one_added:   # which of several overlapping strings is taken is the library's choice
            return self.whole(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        total, at = 0, 0
        while at < len(text):
            cut = _SAFE_CUT.search(text, at + SLICE) if len(text) > at + SLICE else None
            end = cut.start() if cut else len(text)
            total += self._slice(text if not at and end == len(text) else text[at:end])
            at = end
        return total

    def _slice(self, text: str) -> int:
        words = _PRE_TOKEN.findall(text)
        counts = list(map(self.table.get, words))
        if None not in counts:
            return sum(counts)
        rest = [w for w, n in zip(words, counts) if n is None]
        counts = list(map(self.now.get, rest)) + [n for n in counts if n is not None]
        if None in counts:
            fresh = self._learn({w for w, n in zip(rest, counts) if n is None})
            counts = [fresh[w] if n is None else n for w, n in zip(rest, counts)] + counts[len(rest):]
        return sum(counts)

    def _learn(self, missing: set[str]) -> dict[str, int]:
        """Counts of pre-tokens that the newer cache lacks; those that the older one lacks too are encoded together.

        Pre-tokens that start with a space stay apart when they are joined, the
        others when newlines stand between them.
        """
        found = {w: self.old[w] for w in missing if w in self.old}
        fresh = sorted(missing - found.keys())
        self.misses += len(fresh)
        spaced = [w for w in fresh if w[0] == " " and not w.isspace()]
        bare = [w for w in fresh if not w[0].isspace()]
        found |= self._together(spaced, "") | self._together(bare, "\n")
        found |= {w: self.whole(w) for w in missing - found.keys()}
        if len(self.now) >= self.max_words // 2:
            self.now, self.old = {}, self.now
        self.now.update((w, n) for w, n in found.items() if len(w) <= LONGEST_KEPT)
        return found

    def _together(self, words: list[str], between: str) -> dict[str, int]:
        if not words:
            return {}
        ids = self.tok.encode(between.join(words), add_special_tokens=False).word_ids
        counts = np.bincount(np.array(ids, "i8"))[::2 if between else 1]
        return dict(zip(words, counts.tolist())) if len(counts) == len(words) else {}


def frequent_table(docs: DataFrame, text_col: str, path: str, *, sample_rows: int = 4096, table_words: int = 1 << 16, tasks: int = 8) -> Table:
    """Table of the pre-tokens that are most frequent in about ``sample_rows`` documents.

    Each of ``tasks`` tasks sends its ``table_words`` most frequent ones at most.
    """
    if not is_byte_level(path):
        return Table(path, path, None)
    tok = load(path)
    n = docs.count()
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    if n > sample_rows:
        texts = texts.sample(fraction=sample_rows / n, seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(w for w in _PRE_TOKEN.findall(text) if len(w) <= LONGEST_KEPT)
        top = sorted(seen.items(), key=lambda e: (-e[1], e[0]))[:table_words]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], names=["w", "c"])

    total: Counter = Counter()
    for row in texts.repartition(tasks).mapInArrow(run, "w string, c bigint").toLocalIterator():
        total[row.w] += row.c
    words = [w for w, _ in islice(sorted(total.items(), key=lambda e: (-e[1], e[0])), table_words)]
    counts = np.array([len(e.ids) for e in tok.encode_batch(words, add_special_tokens=False)], "u2")
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw], dtype="u4") if raw else np.zeros(0, "u4")
    doubtful = np.packbits(differing_characters(tok)).tobytes()
    return Table(path, f"{path}:{hash((tuple(words), doubtful))}", doubtful, b"".join(raw), ends, counts)


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, sample_rows: int = 4096,
                 table_words: int = 1 << 16) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row: the tokens that the library of the file at ``path`` gives for the whole text.

    The broadcast holds at most ``table_words`` pre-tokens of ``LONGEST_KEPT`` characters.
    """
    table = frequent_table(docs, text_col, path, sample_rows=sample_rows, table_words=table_words)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        if t.key not in _WORKER:
            _WORKER.clear()
            _WORKER[t.key] = PreTokenCounter(t)
        counter = _WORKER[t.key]
        for b in batches:
            texts = b.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            counts = np.fromiter((counter.count(x.as_py()) for x in texts), "i8", len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(counts)], names=["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
