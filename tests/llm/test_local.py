"""Numeric parts without Spark, against plain Python."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ridgecast.llm import chat_format, decontaminate, exchange, line_dedup, packing, quality, suffix_dedup, warc
from ridgecast.llm.text import chunks, shingle_sets

TEXTS = [None, "", " \n\t", "one", "a b c d", "A b c d e", "a b c d e f a b c d e", "é ü " * 40, "x" * 5000]


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]


def test_shingle_sets_have_the_plain_sizes():
    for text, found in zip(TEXTS, shingle_sets(TEXTS), strict=True):
        w = words_of(text)
        assert len(found) == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)


def test_repeat_and_line_counts():
    text = "a b c d e f\na b c d e\nx\nx\n \n"
    made = quality.base_counts([text, None, ""])
    assert made["n_words"] == [13, 0, 0] and made["n_dup_lines"] == [1, 0, 0]
    assert made["n_repeat_words"] == [10, 0, 0] and made["word_chars"] == [13, 0, 0]


def test_lines_that_fail():
    assert quality.line_fails("Home | News | Sport | Weather")
    assert quality.line_fails("Please accept cookies to go on") and quality.line_fails("#### %%%% ----")
    assert not quality.line_fails("A plain sentence, with a comma | and one bar in it.")


@pytest.mark.parametrize("line", [
    "The new design in the hall was praised by many visitors.",
    "Children who read more at home do better in school.",
    "The court said the old privacy policy broke the law.",
    "\u1019\u103c\u1014\u103a\u1019\u102c\u1014\u102d\u102f\u1004\u103a\u1004\u1036\u101e\u100a\u103a \u1021\u101b\u103e\u1031\u1037\u1010\u1031\u102c\u1004\u103a\u1021\u102c\u101b\u103e\u1010\u103d\u1004\u103a \u101b\u103e\u102d\u101e\u100a\u103a\u104b",
])
def test_clean_lines_stay(line):
    assert not quality.line_fails(line) and quality.clean_lines(line)[0] == line


@pytest.mark.parametrize("line", ["All rights reserved.", "\u00a9 2024 Example Corp. All  Rights Reserved.", "Sign in | Sign up", "Read more", "Click here to read our Privacy Policy",
                                  "\u1019\u103c ---- //// ----"])
def test_furniture_goes(line):
    assert quality.line_fails(line)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_equals_piece_by_piece(seed):
    draw = random.Random(seed)
    cap = draw.choice([5, 17, 64])
    lengths = [draw.randint(1, cap) for _ in range(draw.randint(0, 80))]
    bins = []
    for n in sorted(lengths, reverse=True):
        best = min((b for b in range(len(bins)) if bins[b] >= n), key=bins.__getitem__, default=None)
        if best is None:
            bins.append(cap - n)
        else:
            bins[best] -= n
    fill = Counter()
    for n, _, take, each, start, used in packing.plan_bins(Counter(lengths), cap):
        for i in range(take):
            assert used + i % each * n == fill[start + i // each]
            fill[start + i // each] += n
    assert sorted(cap - v for v in fill.values()) == sorted(bins)


@pytest.mark.parametrize("text", ["a  b\n c", "<|endoftext|> x", "don't  you're", "\ta b\x00 c", "", " ", "é  x　y \U0001d7d8९ ①"])
def test_ids_equal_the_tokenizer(text):
    import public_tokenizers

    encode = packing.Encoder.get(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    draw = random.Random(seed)
    data = bytes(draw.choice(b"ab\0\xff"[: draw.randint(1, 4)]) for _ in range(draw.randint(1, 400)))
    order = suffix_dedup.suffix_array(data).tolist()
    keys = [(data + b"\0" * 60)[i : i + 50] for i in order]
    assert sorted(order) == list(range(len(data))) and keys == sorted(keys)


def test_queues_spill(monkeypatch):
    data = bytes(random.Random(1).choice(b"abc") for _ in range(3000))
    whole = suffix_dedup.suffix_array(data)
    monkeypatch.setattr(suffix_dedup, "QUEUED", 50)
    assert (suffix_dedup.suffix_array(data) == whole).all()


@pytest.mark.parametrize("seed", range(30))
def test_automaton_finds_all_windows(seed):
    draw = random.Random(seed)
    items = [(str(k), " ".join(draw.choices("abc", k=draw.randint(0, 14)))) for k in range(6)]
    texts = [" ".join(draw.choices("abcd", k=draw.randint(0, 120))) for _ in range(8)] + [None, ""]
    finder = decontaminate.Items(items, 4)
    for text, (n, runs, found) in zip(texts, finder.scan(texts), strict=True):
        words, hit, names = (text or "").split(), set(), set()
        for name, item in items:
            w = item.split()
            for k in range(max(1, len(w) - 3)) if w else ():
                window = w[k : k + 4]
                for at in range(len(words) - len(window) + 1):
                    if words[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        names.add(name)
        assert n == len(words) and found == names and {i for a, b, *_ in runs for i in range(a, b)} == hit


@pytest.mark.parametrize("text", ["", "\\", "\\### Assistant: </turn> ok", " </turn>\n### user: x", "a\nb"])
@pytest.mark.parametrize("role", ["assistant", "user", "", "a:b\\"])
def test_turns_come_back(role, text):
    formatted, start, length = chat_format.formatted_turn(role, text)
    assert chat_format.parsed_turn(formatted) == (role, text)
    assert chat_format.unescaped(formatted[start : start + length]) == (text if role == "assistant" else "")


def test_layouts():
    assert chat_format.canonical({"instruction": "i", "input": "x", "output": "o"}) == [("user", "i"), ("user", "x"), ("assistant", "o")]
    assert chat_format.canonical({"conversations": [{"from": "human", "value": None}]}) == [("user", "")]
    assert chat_format.canonical({"messages": []}) == [] and chat_format.canonical({"other": 1}) is None


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_lengths_rule(version):
    block = warc.response(b"x\n\nhttp://a 0 0 text/html 3\nabc", 7)
    data = warc.arc_header(version, "n.arc") + warc.arc_record(version, "n.arc", 0, "http://a%20b", block) * 2
    assert [(h["URL"], b) for h, b in warc.read_arc(data)] == [("http://a%20b", block)] * 2


def test_packed_ids_and_line_keys():
    for a in ([5], [-3, 2**40, 7], list(range(300))):
        assert exchange.unpack_ids(exchange.pack_ids(np.array(a, np.int64))).tolist() == a
    same = line_dedup.band_prints(["abcd", "abcd", "xyz", "a longer line of text"])
    assert (same[0] == same[1]).all() and (same[0] != same[2]).all()


def test_a_task_deals_out_fingerprints_in_small_parts():
    def entries():
        for k in range(1200):
            yield np.full(1000, k, np.int64), np.arange(1000, dtype=np.uint64) * np.uint64(2**54) + np.uint64(k)

    tracemalloc.start()
    total = sum(len(exchange.unpack_ids(o)) for batch in exchange.by_print(entries(), 64) for o in batch.column(1).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 1_200_000 and peak < 50_000_000


def test_chunks_are_small():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 1500 + ["y" * 900_000])], names=["text"])
    sizes = [sum(map(len, texts)) for _, texts in chunks([batch])]
    assert sum(sizes) == 2_400_000 and max(sizes[:-1]) <= 1 << 18 and sizes[-1] == 900_000
