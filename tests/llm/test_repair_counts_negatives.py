"""Conversation repair, token counts and hard negatives against brute force."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from topicscope.llm import conversation_repair, hard_negatives, queries, token_counts

TOK = public_tokenizers.path("byte_bpe_50k.json")
sys.setrecursionlimit(20_000)   # the brute force recurses by row


# ---------------------------------------------------------------- 11 conversation repair

def brute_damage(rows):
    """(conv, turn, role, text) after damage, by the contract's words."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        rule, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if rule == 0:
            continue
        text = "" if rule == 1 else re.sub(r"[.!?]", "", text) if rule == 2 else text
        out += [(conv, turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    return out


def brute_repair(rows):
    """Counts, cost, audit and repaired turns of one conversation's ordered rows, by exhaustive recursion."""
    seen, faults, initials = set(), [], [r[:1] for r, _ in rows]
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts):
        """(cost, audit, turns) of the rest; ``state`` is the last output's initial, or '' before any."""
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        nxt = "assistant" if state == "u" else "user"

        def add(cost, edit, turn, rest):
            if rest:
                options.append((cost + rest[0], edit + rest[1], (turn, *rest[2]) if turn else rest[2]))
        if inserts < 2:   # more in a row come back to the same state
            add(3, "I", (nxt, ""), best(i, nxt[0], inserts + 1))
        if i < len(rows):
            role, text = rows[i]
            add(4, "D", None, best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                add(3 + extra, "R", (nxt, text), best(i + 1, nxt[0], 0))
                c = role[:1]
                if (c == "s" and state == "") or (c == "u" and state in ("", "s", "a")) or (c == "a" and state == "u"):
                    add(extra, "K", (role, text), best(i + 1, c, 0))
        return min(options, default=None)

    cost, audit, turns = best(0, "", 0)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, turns


def brute_all(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role, text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], token_order(t[2])))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        *counts, cost, audit, repaired = brute_repair(tuple((r, x) for _, r, x in turns))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
        out[conv] = (gaps, *counts, cost, audit, digest)
    return out


def token_order(text):
    """Stands for the operator's digest order of texts in ties of turn and role; the fixtures have none but equal rows."""
    return text


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, kind string, h1 int"


def random_turns(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "usher", None])
            text = rng.choice([f"Yes {turn}.", f"no {turn}", "Same.", "Same.", " \t", "", None, "Wait! \n", "x "])
            rows.append((conv, turn if rng.random() < 0.95 else turn + 1000, role, text))
    return rows


def got_repairs(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("block", [3, 64])
def test_repair_equals_brute_force(spark, block):
    """Short blocks make every conversation a composition; eight range partitions cut some of them."""
    rows = random_turns(1, 60, 12) + [(500, t, random.Random(t).choice(["user", "assistant"]), f"long {t % 50}." if t % 3 else "cut") for t in range(400)]
    rows = [(c, t, r or ("user" if r is None else r), x) for c, t, r, x in rows]
    one_per_turn = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    rows = one_per_turn + one_per_turn[::7]   # repeated rows
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA).repartition(5)
    got = got_repairs(conversation_repair.repair(df, block=block))
    exp = brute_all([(c, t, r, " " if x is None else x) for c, t, r, x in rows])
    assert got == exp
    turns = defaultdict(list)
    for r in conversation_repair.repair_turns(df, block=block).orderBy("place").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
        assert r.place == len(turns[r.conv_id]) - 1
    digests = {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in got}
    assert digests == {c: v[-1] for c, v in got.items()}
    for c in got:
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in turns[c]))


def test_composed_blocks_equal_one_run():
    rng = random.Random(4)
    for _ in range(200):
        classes = "".join(rng.choice("suaoSUAOd") for _ in range(rng.randint(0, 30)))
        at = rng.randint(0, len(classes))
        assert conversation_repair.compose(conversation_repair.table(classes[:at]), conversation_repair.table(classes[at:])) == conversation_repair.table(classes)


def test_repair_query_equals_brute_force(spark, monkeypatch):
    rows = random_turns(2, 150, 8) + [(200, None, "user", "A."), (200, None, "user", "A."), (201, 5, None, None)]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    every = {r[0] for r in rows}
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)
    monkeypatch.setattr(queries, "read_table", lambda s, d, name: {"conversations": df}[name])
    got = got_repairs(queries.op11_conversation_repair(spark, ""))
    exp = brute_all(brute_damage(rows))
    assert got == {c: exp.get(c, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) for c in every}


def test_repair_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(empty).count() == 0 and conversation_repair.repair_turns(empty).count() == 0
    rows = [(1, 1, "user", "x" * 300_000 + "."), (2, 1, "assistant", "Hi."), (3, 1, "user", " "), (None, None, None, None), (4, 0, "system", "S."),
            (4, 1, "user", "Q?"), (4, 2, "assistant", "A."), (4, 2, "assistant", "A.")]
    got = got_repairs(conversation_repair.repair(spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)))
    # a kept user turn needs an answer (3) and beats its deletion (4); a lone assistant turn needs a question
    assert got[1][5:7] == (3, "KI") and got[2][5:7] == (3, "IK") and got[3][5:7] == (4, "D") and got[4][5:7] == (4, "KKKD")
    assert got[None] == (0, 1, 0, 0, 0, 4, "D", hashlib.sha256(b"").hexdigest())


def test_hot_conversation_is_spread(spark):
    """A third of the rows in one conversation, most of them equal, over many range partitions."""
    n = 6000
    hot = [(7, t, "user" if t % 2 == 0 else "assistant", "Same." if t % 3 else f"t{t}.") for t in range(n)]
    rows = hot + [(100 + c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(1000) for t in range(12)]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    got = got_repairs(conversation_repair.repair(df))
    classes, seen = "", set()
    for _, _, role, text in hot:
        classes += "d" if (role, text) in seen else role[0]
        seen.add((role, text))
    cost, audit = conversation_repair.lightest(classes, 0, (0, 3)).popitem()[1]
    assert got[7][5:7] == (cost, audit) and got[7][2] == classes.count("d")
    assert all(got[100 + c][5:7] == (0, "K" * 12) for c in range(1000))


# ---------------------------------------------------------------- 12 token counts

def test_token_counts_equal_library(spark):
    tok, rng = Tokenizer.from_file(TOK), random.Random(3)
    pool = ["a", "É", "ß", "1", "²", "٣", " ", "  ", "\n", "\t", " ", "　", "'s", "'", "’", "<|endoftext|>", "<|", "!", "中", "̀", "😀", "\x1f",
            "\x85", " ", "᠎", "​", "'ll", "\U0001e030", "", "\U000e01ff", "word", " word"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    texts += ["", None, " \n\t ", "x" * 20_000, "the cat sat on a mat " * 20_000, "<|endoftext|>", "one <|endoftext|> two", "same", "same"]
    docs = spark.createDataFrame([(i if i % 50 else None, t, 1, 2, "t") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int, id int, w string")
    exp = sorted((i if i % 50 else -1, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    for sample, words in ((10_000, 1 << 16), (20, 5)):   # a table that knows nearly all, and one that knows next to nothing
        got = token_counts.count_tokens(docs, TOK, limit=1024, sample_rows=sample, table_words=words).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == exp
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and any(r.over_limit for r in got)
    assert token_counts.count_tokens(docs.limit(0), TOK).count() == 0
    assert "Exchange" not in token_counts.count_tokens(docs, TOK)._jdf.queryExecution().executedPlan().toString()   # no shuffle beside the sample's


def test_token_counts_of_other_tokenizers_and_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Hello  World, ÉTÉ!"), (2, None)], "doc_id bigint, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {1: len(Tokenizer.from_file(path).encode("Hello  World, ÉTÉ!", add_special_tokens=False).ids), 2: 0}
    tok = token_counts.load(TOK)
    counter = token_counts.PreTokenCounter(token_counts.Table(TOK, "k", np.packbits(token_counts.differing_characters(tok)).tobytes()), max_words=8)
    monkeypatch.setattr(token_counts, "SLICE", 7)
    rng = random.Random(9)
    for _ in range(500):
        t = "".join(rng.choice(["ab", " ", "  ", "\n", "9", "'s", " c", "É"]) for _ in range(40))
        assert counter.count(t) == counter.whole(t)
        assert len(counter.now) + len(counter.old) <= 8 + 40


# ---------------------------------------------------------------- 13 hard negatives

VECTORS = "vec_id bigint, label int, embedding array<float>, v string, row int"


def brute_mine(rows, n_pos=5, n_neg=5):
    """By the contract's words over (id, label, vector) rows, with plain integers."""
    use = [(i, lab, [math.floor(256 * float(np.float32(c))) for c in v]) for i, lab, v in rows
           if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    order = lambda e: (-e[0], e[1] is None, e[1] or 0)
    out = []
    for at, (a, lab, v) in enumerate(use):
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, other) for k, (i, other, w) in enumerate(use) if k != at]
        for p, pid, _ in sorted((e for e in scored if e[2] == lab), key=order)[:n_pos]:
            band = sorted((e for e in scored if e[2] != lab and 80 * p <= 100 * e[0] <= 100 * p), key=order)[:n_neg]
            out += [(a, pid, r, i, p, s) for r, (s, i, _) in enumerate(band, 1)]
    return sorted(out, key=str)


def mined(df, **kw):
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **kw).collect()), key=str)


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 4 if i % 3 else 0), [float(c) for c in rng.normal(0.4, 0.3, 6)]) for i in range(900)]
    rows += [(1000 + i, i % 2, [0.5] * 6) for i in range(300)]                            # a very common vector: ties
    rows += [(100, 1, [0.1] * 6), (100, 1, [0.1] * 6), (100, 0, rows[100][2]), (None, 1, [0.5] * 6), (None, 0, [0.9] * 6)]
    rows += [(2000, None, [1.0] * 6), (2100, 1, None), (2200, 1, [1.0, None]), (2300, 1, [float("nan")]), (2400, 1, [float("inf")]), (2500, 2, []),
             (2600, 2, [0.7, 0.7]), (2700, 9, [0.3] * 6)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTORS)
    exp = brute_mine(rows)
    assert len(exp) > 100
    for blocks in (100, 5000):
        assert mined(df, block_rows=blocks) == exp
    assert mined(df.limit(0)) == []


def test_packed_products_are_exact():
    """Lanes of 64 bits and wide Python integers unpack to the same scores as plain products."""
    rng = np.random.default_rng(1)
    for size in (3, 200, 100_000, 1 << 40):
        x, a = rng.integers(-size, size, (37, 9)), rng.integers(-size, size, (5, 9))
        packed = hard_negatives.Packed(x.astype("f8"), -size, size)
        assert packed.lane == (size < 1 << 28) and packed.fields >= (2 if size == 200 else 1)
        exp = a.astype(object) @ x.astype(object).T
        for lo, hi in ((0, 37), (5, 6), (7, 30)):
            assert (packed.scores(a.astype("f8"), lo, hi).astype(object) == exp[:, lo:hi]).all()


def test_wide_components(spark):
    rows = [(i, i % 2, [float(1 << 26) * (1 + i % 7), 1.0]) for i in range(60)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTORS)
    with pytest.raises(Exception, match="Overflow|too (large|big)|int"):
        mined(df)   # a score of over 2^63
    small = [(i, i % 2, [float(1 << 18) * (1 + i % 7), 1.0]) for i in range(60)]
    assert mined(spark.createDataFrame([(*r, "clash", 1) for r in small], VECTORS)) == brute_mine(small)
