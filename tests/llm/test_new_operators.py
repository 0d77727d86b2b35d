"""Conversation repair, Merkle manifest and token files against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgecast.llm import chat_repair, merkle, packing, queries, token_files
from ridgecast.llm.placed import numbered

PLACES = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """All audits with at most two inserts of rows (initial, fault), tried one by one."""
    found = []

    def go(i, last, cost, audit, inserts):
        if i == len(rows) and last in ("", "a"):
            found.append((cost, audit))
        for role in PLACES[last]:
            if role != "s" and inserts < 2:
                go(i, role, cost + 5, audit + "I", inserts + 1)
        if i == len(rows):
            return
        initial, wrong = rows[i]
        go(i + 1, last, cost + 2, audit + "D", inserts)
        if wrong not in ("blank", "duplicate"):
            more = 5 * (wrong == "truncated")
            for role in PLACES[last]:
                if role == initial:
                    go(i + 1, role, cost + more, audit + "K", inserts)
                if role != "s":
                    go(i + 1, role, cost + more + 1, audit + "R", inserts)

    go(0, "", 0, "", 0)
    return min(found)


def some_rows(draw, n):
    return [(draw.choice("suauax"), draw.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)]


def test_agenda_finds_the_cheapest_audit():
    draw = random.Random(3)
    for _ in range(400):
        rows = some_rows(draw, draw.randint(0, 6))
        assert list(chat_repair.derive(rows).values()) == [plain_repair(rows)]


def test_blocks_compose_to_the_whole():
    draw = random.Random(4)
    for _ in range(100):
        rows, size = some_rows(draw, draw.randint(1, 60)), draw.randint(1, 9)
        blocks = [rows[i : i + size] for i in range(0, len(rows), size)]
        parts = (chat_repair.derive(b, chat_repair.STATES if k else (0,), goal=False) for k, b in enumerate(blocks))
        assert [chat_repair.compose(parts)] == list(chat_repair.derive(rows).values())


@pytest.fixture(scope="module")
def turns(spark):
    draw = random.Random(6)
    rows = [(c, t, draw.choice(["user", "assistant", "system", None, "x"]), draw.choice(["One.", "Two!", "cut", " \n", None, f"n{t}?"])) for c in range(12) for t in range(draw.randint(1, 7))]
    rows += [(50, t // 2, "ua"[t % 2], f"line {t}" + ".!x"[t % 3]) for t in range(300)] + [(None, 1, "user", "A."), (None, None, "assistant", "B."), (7, 2**40, "user", "A.")] + rows[:2]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5).cache()


def test_repair(spark, turns):
    by = {}
    for r in turns.collect():
        role, text = (" " if x is None else x for x in (r.role, r.text))
        mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        by.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, mark, role, text))
    want = {}
    for conv, rows in by.items():
        rows.sort()
        seen, facts = set(), []
        for _, _, _, role, text in rows:
            facts.append((role[:1], chat_repair.fault(text, (role, text) in seen)))
            seen.add((role, text))
        numbers = {t for known, t, *_ in rows if known}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(facts, facts[1:]))
        (cost, audit), = chat_repair.derive(facts).values()
        if len(facts) <= 8:
            assert (cost, audit) == plain_repair(facts)
        lines, left, last = [], [r[3:] for r in rows], ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else left.pop(0)
            if edit != "D":
                last = role[0] if edit == "K" else "a" if last == "u" else "u"
                lines.append((role if edit == "K" else {"a": "assistant", "u": "user"}[last]) + ":" + text)
        faults = [sum(w == k for _, w in facts) for k in ("blank", "duplicate", "truncated")]
        want[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    for block in (2, 256, 10_000):  # nearly all by blocks, one, none
        got = {r[0]: tuple(r[1:]) for r in chat_repair.repair(turns, block).collect()}
        assert got == want
    assert chat_repair.repair(turns.filter("false")).count() == 0


def test_repair_of_nothing(spark, tmp_path):
    rows = [(1, 0, None, None), (None, 3, "user", "Hm.")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op11_chat_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {1, None} and all(r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in got.values())


def test_places(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "b").otherwise("c").alias("g"), ((F.col("id") * 7) % 400).alias("v")).repartition(6)
    got = {}
    for r in numbered(rows, "g", ["v"]).orderBy("g", "nth").collect():
        got.setdefault(r.g, []).append((r.v, r.nth, r.size))
    for found in got.values():
        assert [n for _, n, _ in found] == list(range(len(found))) and {s for _, _, s in found} == {len(found)}
        assert [v for v, _, _ in found] == sorted(v for v, _, _ in found)
    assert numbered(rows.filter("false"), "g", ["v"]).count() == 0


def plain_tree(nodes):
    """The root and each leaf's siblings, level by level."""
    spots, paths, now = list(range(len(nodes))), [[] for _ in nodes], list(nodes)
    while len(now) > 1:
        for k, s in enumerate(spots):
            if s ^ 1 < len(now):
                paths[k].append(now[s ^ 1])
        spots = [s // 2 for s in spots]
        now = [hashlib.sha256("".join(now[i : i + 2]).encode()).hexdigest() for i in range(0, len(now), 2)]
    return now[0], paths


def test_streamed_witnesses():
    for n in (*range(1, 35), 64, 100):
        nodes = [merkle.join(str(k)) for k in range(n)]
        tree = merkle.Tree()
        for node in nodes:
            tree.append(node)
        root, paths = plain_tree(nodes)
        assert tree.finish(merkle.levels(n)) == root and tree.witness == paths
        assert {merkle.fold(nodes[k], k, n, paths[k]) for k in range(n)} == {root}


@pytest.mark.parametrize("height", [1, 3, 10])
def test_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = [(k, f"s{k % 5}", (None, "en", "de", "é")[k % 11 % 4], k if k % 6 else None, "é" * (k % 4) if k % 7 else None) for k in range(90)]
    rows += [rows[5], rows[5], (None, None, None, None, None), (5, "other", "en", 5, "x"), (200, "long", "en", 1, "word " * 100_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, nth int").repartition(4)

    def plain_leaf(r):
        return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r).encode()).hexdigest()

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names])
    want = []
    for g, top in zip(names, tops):
        for (known, key, node), path in zip(sorted(groups[g]), trees[g][1]):
            want.append((key if known else None, node, trees[g][0], root, "".join(path + top)))
    made = merkle.manifest(docs)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.siblings.hex()) for r in made.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert merkle.folded(made).filter("folded_root != root").count() == 0
    assert merkle.folded(made.withColumn("leaf", F.sha2("leaf", 256))).filter("folded_root = root").count() == 0
    assert merkle.manifest(docs.filter("false")).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [7] * 9, [7] * 10, [1, 2] * 50, [70000, 70001] * 40, [3] * 33 + [4] * 17 + [3] * 5])
def test_grammar_round_trip(ids):
    ids = np.array(ids, np.uint32)
    symbols, rules, first = token_files.compress(ids)
    assert token_files.expand(symbols, rules, first).tolist() == ids.tolist()
    assert len(symbols) < len(ids) or len(ids) < 2


def test_random_access():
    draw = np.random.default_rng(5)
    phrases = [draw.integers(0, 50_000, 6) for _ in range(40)]
    ids = np.concatenate([phrases[k] for k in draw.integers(0, 40, 3000)]).astype(np.uint32)
    lengths = [100] * (len(ids) // 100)
    ids = ids[: sum(lengths)]
    data = token_files.write_shard([None, *range(1, len(lengths))], lengths, ids, 17)
    assert len(data) < ids.nbytes / 2
    shard, = token_files.shards(data + b"\n")
    assert shard.start == 17 and shard.doc_ids[:2] == [None, 1] and (shard.document(3) == ids[300:400]).all()
    for _ in range(300):
        a = int(draw.integers(0, len(ids)))
        n = int(draw.integers(0, min(2000, len(ids) - a + 1)))
        assert (shard.ids(a, n) == ids[a : a + n]).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    rows = [(5, "one two one two"), (3, None), (None, "no id"), (4, ""), (5, "one two one two"), (9, "é <|endoftext|> x"), (5, "another"), (8, "la " * 60_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int").repartition(3)
    whole = Tokenizer.from_file(queries.tokenizer_files()[0])
    coded = {r: np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}
    for size in (1, 50, 1 << 20):
        files = token_files.write_token_files(docs, *queries.tokenizer_files(), size)
        got = token_files.read_token_files(files).orderBy("start").collect()
        assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
        assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(coded[r]), zlib.crc32(coded[r].tobytes())) for r in rows)
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert token_files.read_token_files(token_files.write_token_files(docs.filter("false"), *queries.tokenizer_files())).count() == 0


def test_rounds_of_a_grammar_get_short(monkeypatch):
    """Places whose pair cannot occur twice are counted once, not in every round; a plain round finds the same rules."""
    draw = np.random.default_rng(9)
    phrases = [draw.integers(0, 4000, n) for n in draw.integers(2, 9, 300)]
    ids = np.concatenate([*(phrases[k] for k in draw.zipf(1.2, 6000) % 300), draw.integers(0, 60_000, 20_000), [5] * 99]).astype(np.uint32)
    sizes, plain, frequent = [], ids.tolist(), token_files._frequent

    def watched(codes, shift, *rest):
        sizes.append(len(codes))
        found = frequent(codes, shift, *rest)
        every = np.array([(a << shift) | b for a, b in zip(plain, plain[1:])], codes.dtype)
        known, times = np.unique(every, return_counts=True)
        assert (known[times > 1] == np.unique(found[1])).all()
        number = {int(c): top[0] + k for k, c in enumerate(found[0])}
        out, k = [], 0
        while k < len(plain):
            symbol = number.get((plain[k] << shift) | plain[k + 1]) if k + 1 < len(plain) else None
            out.append(plain[k] if symbol is None else symbol)
            k += 1 if symbol is None else 2
        plain[:] = out
        top[0] += len(number)
        return found

    top = [int(ids.max()) + 1]
    monkeypatch.setattr(token_files, "_frequent", watched)
    symbols, rules, first = token_files.compress(ids)
    assert symbols.tolist() == plain and first + len(rules) == top[0] and (token_files.expand(symbols, rules, first) == ids).all()
    assert sizes[0] == len(ids) - 1 and sizes[-1] < len(symbols) / 20


def test_grammar_goes_on_until_no_pair_repeats():
    """Also in a shard of many ids, where a pair that is rare beside the others still becomes a rule."""
    ids = np.random.default_rng(3).zipf(1.3, 40_000).clip(0, 3000).astype(np.uint32)
    symbols, rules, first = token_files.compress(ids)
    seen, last = {}, None
    for k, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist())):
        assert seen.setdefault(pair, k) in (k, k - 1)  # a run of three counts once
    assert (token_files.expand(symbols, rules, first) == ids).all()


def test_ids_come_without_looking_ahead(monkeypatch):
    """Texts are cut where white space would make the pattern look ahead; only those with very many such places are not."""
    encode = packing.Encoder(*queries.tokenizer_files())
    looked, ordinary = [], encode.ranks.encode_ordinary
    monkeypatch.setattr(encode.ranks, "encode_ordinary", lambda text: looked.append(text) or ordinary(text))
    draw = random.Random(4)
    signs = [*map(chr, range(0x40)), *"'st'llab1٣éñ̈漢\x85\xa0 ᠎ ​  　﻿", *["\n", " ", "  ", "\t", "\r\n"] * 4]
    texts = ["", " ", " \n", "a  b", *("".join(draw.choices(signs, k=draw.randrange(30))) for _ in range(3000))]
    for text in texts:
        for long in (text, "a word's " * 900 + text + " end" * 900):
            assert np.frombuffer(encode(long), np.uint32).tolist() == encode.whole.encode(long, add_special_tokens=False).ids
    assert looked and max(map(len, looked)) < 100


def test_pairs_of_a_round_are_taken_in_order(monkeypatch):
    """A pair is left out if one taken before ends with its first or begins with its last symbol, also when pairs are looked at together."""
    draw = np.random.default_rng(8)
    for symbols, passes in ((4, 1), (30, 1), (30, 2), (30, token_files.PASSES), (3000, token_files.PASSES)):
        monkeypatch.setattr(token_files, "PASSES", passes)
        codes = ((draw.integers(0, symbols, 3000) << 16) | draw.integers(0, symbols, 3000)).astype(np.uint32).repeat(2)
        if symbols == 30:
            codes = np.concatenate([codes, ((np.arange(100, 160) << 16) | np.arange(101, 161)).astype(np.uint32).repeat(5)])  # a chain
        known, times = np.unique(codes, return_counts=True)
        want, begin, end = [], set(), set()
        for code, n in sorted(zip(known.tolist(), times.tolist()), key=lambda x: (-x[1], x[0])):
            a, b = code >> 16, code & 0xFFFF
            if n >= token_files.ROUND_SHARE * times.max() and a not in end and b not in begin and (a != b or a not in begin):
                want.append(code)
                begin.add(a)
                end.add(b)
        chosen, often = token_files._frequent(codes, 16, 2, max(symbols, 161))
        assert chosen.tolist() == sorted(want) and often.tolist() == known.tolist()
