"""Operators on small tables with nulls, repeats, clashing names and no rows."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ridgecast.llm import chat_format, decontaminate, language_id, license_scan, line_dedup, ngram_join, packing, quality, queries, suffix_dedup, warc

WORDS = [a + b + c for a in "bdfg" for b in "aeiou" for c in "lmnrs"]


def texts():
    draw = random.Random(5)
    base = [" ".join(draw.choices(WORDS, k=60)) for _ in range(8)]
    near = [" ".join(w if k != 30 else f"new{n}" for k, w in enumerate(base[0].split())) for n in range(5)]
    return [*base, *near, base[1], base[1], None, "", "one two", base[2] + "\n" + base[3], "\n".join(base[4:6] * 2)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts())]
    rows += [rows[3], (None, rows[0][1], None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, kept int").repartition(3).cache()


def none(docs):
    return docs.filter("false")


def test_ngram_join(docs):
    sets = {}
    for k, t in enumerate(texts()):
        w = (t or "").split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(texts()) + 2
    assert all(r.component_id == (None if r.doc_id is None else root[r.doc_id]) for r in got)
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got if r.doc_id is not None)
    assert ngram_join.jaccard_components(none(docs)).count() == 0
    assert ngram_join.stage(docs).columns == docs.columns


def test_suffix_dedup(docs):
    seen, expected = set(), {}
    for k, t in enumerate(texts()):
        raw = (t or "").encode()
        windows = [raw[i : i + 50] for i in range(len(raw) - 49)]
        gone = {j for i, w in enumerate(windows) if w in seen for j in range(i, i + 50)}
        seen |= set(windows)
        expected[k] = bytes(b for i, b in enumerate(raw) if i not in gone)
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert len(got) == len(texts()) + 2
    assert all(bytes(r.kept) == expected[r.doc_id] for r in got if r.doc_id is not None)
    assert suffix_dedup.suffix_dedup(none(docs)).count() == 0


def test_line_dedup(docs):
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[0].n_removed == 0 and got[8].n_removed == 1 and got[8].text == ""
    assert got[13].n_removed == got[14].n_removed == 1 and got[17].n_removed == 0
    assert got[15].text is None and got[None].n_removed == 0
    assert got[18].n_removed == 2 and got[19].n_lines == 4 and got[19].n_removed == 4
    assert line_dedup.line_dedup(none(docs)).count() == 0
    assert line_dedup.stage(docs).columns == docs.columns


def test_quality(docs):
    got = quality.quality_rules(docs)
    assert got.columns.count("kept") == 1 and got.count() == docs.count()
    assert {r.doc_id for r in got.filter("base_failed").collect()} >= {15, 16, 17}
    assert {r.doc_id for r in got.filter("kept").collect()} >= set(range(13))
    assert quality.quality_rules(none(docs)).count() == 0


def test_decontamination(spark, docs):
    item = " ".join(texts()[0].split()[5:20])
    bench = spark.createDataFrame([("7", item), (None, "one two"), ("9", None)], "item_id string, text string")
    for size in (1 << 20, 40):  # one group of items, and several
        got = {r.doc_id: r for r in decontaminate.find_hits(docs, bench, group_bytes=size).collect()}
        assert got[0].hit_items == ["7"] and got[0].hit_words == [5, 20] and got[17].hit_words == [0, 2] and got[17].hit_items == []
        assert got[1].hit_words == [] and got[15].n_words == 0
    cut = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert cut[0].n_hit == 15 and item not in cut[0].text and cut[17].dropped and cut[1].text == texts()[1]
    assert decontaminate.decontaminate(docs, bench.filter("false")).filter("contaminated").count() == 0


def test_packing(docs):
    got = packing.best_fit_packing(docs, *queries.tokenizer_files(), 64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert {r.doc_id for r in got} == {*range(len(texts())), None}
    assert packing.best_fit_packing(none(docs), *queries.tokenizer_files(), 64).count() == 0


def test_chats(spark):
    rows = [(1, 0, '{"role": "user", "text": null}'), (1, 1, '{"role": "assistant", "text": "<a>"}'), (2, 0, '{"z": 1}'), (3, 0, None),
            (4, 0, '{"prompt": "p", "response": "### r"}')]
    records = spark.createDataFrame(rows, "conv_id bigint, turn bigint, record string")
    formatted = chat_format.format_chats(records)
    assert formatted.filter("formatted is null").count() == 2
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\n<a>\n").hexdigest() and got[1].loss_chars == 3
    assert got[4].loss_sha256 == hashlib.sha256(b"### r").hexdigest() and set(got) == {1, 4}


def test_languages(spark):
    draw = random.Random(2)
    rows = [(k, " ".join(draw.choices(WORDS if k % 2 else [w[::-1].upper() for w in WORDS], k=30)), "ab"[k % 2]) for k in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, "a"), (901, "123 !", None), (None, "bal", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fitted(docs)).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in rows) >= 295
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fitted(none(docs))).collect()} == {"und"}


def test_licences(spark):
    rows = [(1, "Hello.\nReleased under the MIT License.\nBye."), (2, "She lost her driving license."), (3, None), (4, ""), (None, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].families == "mit" and got[1].n_paragraphs == 3 and got[None].families == "cc-by-nc-4.0"
    assert got[2].n_licensed == got[3].n_paragraphs == got[4].n_paragraphs == 0


NOTICES = [  # text, lines or paragraphs with a notice, families; no context of a name is among the model's wordings
    ("Copyright (c) 2024 Example Corp. Released under the MIT License.", 1, "mit"),
    ("Our tool reads maps and draws plans for hikers in the hills. It is released under the MIT licence, and anyone may send changes to the list by mail.", 1, "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", 1, "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 2.", 1, "gpl-2.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", 1, "lgpl-3.0"),
    ("Licensed under CC BY-NC-SA 4.0.", 1, "cc-by-nc-sa-4.0"),
    ("Licensed under CC BY 3.0.", 1, "cc-by-3.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", 1, "cc-by-nc-4.0"),
    ("You can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or later.", 1, "gpl-3.0"),
    ("Dear reader,\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in it.", 1, "mit"),
    ("Licensed under the BSD 3-Clause License.\n\nReleased under the MIT License.", 2, "bsd-3-clause,mit"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", 1, "gpl-3.0"),
    ("The MIT License was written in 1988 and is short.", 0, ""),
    ("She compared the Apache License, Version 2.0 with older ones.", 0, ""),
    ("Released under the Example Home License, version 7.", 0, ""),
    ("Ungte mit dem Zug.", 0, ""),
]


def test_licences_unseen(spark):
    rows = [(k, t) for k, (t, _, _) in enumerate(NOTICES)]
    got = {r.doc_id: (r.n_licensed, r.families) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {NOTICES[k][0]: v for k, v in got.items()} == {t: (n, f) for t, n, f in NOTICES}


def test_licences_by_their_model(spark):
    model, threshold = license_scan.trained(spark)
    names = license_scan.classes()
    counts, regression = model.stages
    assert regression.numClasses == len(names) > 50 and {"mit", "gpl-3.0", "unknown", "none"} <= set(names) and 0 < threshold < 1
    rows = [("this tool is licensed under the mit license", "mit"), ("spread under apache license version 2.0", "apache-2.0"), ("the gnu gpl version 3 was written in 2007", "none"),
            ("this tool is licensed under the harbour house license", "unknown")]
    found = model.transform(spark.createDataFrame(rows, "window string, family string").withColumn("grams", F.expr(license_scan._grams("window")))).collect()
    place, weights = {g: k for k, g in enumerate(counts.vocabulary)}, regression.coefficientMatrix.toArray()
    for r in found:  # the classes' weights of all grams, added up one by one
        words = r.window.split()
        assert {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)} <= set(r.grams)
        scores = [regression.interceptVector[k] + sum(weights[k, place[g]] for g in r.grams if g in place) for k in range(len(names))]
        assert names[scores.index(max(scores))] == names[int(r.prediction)] == r.family


STRANGE = [  # text, families, notices of other licences
    ("This program is licensed under the Harbour House License, version 3.", "", 1),
    ("Released under the Apache License, version 9.5.", "", 1),
    ("Licensed under the terms of either the MIT License or the Apache License 2.0.", "apache-2.0,mit", 0),
    ("He has a driving license and likes the public domain.", "", 0),
    ("Plain words only.", "", 0),
]


def test_licences_of_no_family(spark):
    rows = [(7, t) for t, _, _ in STRANGE[:2]] + [(k, t) for k, (t, _, _) in enumerate(STRANGE)]
    got = {r.doc_id: (r.families, r.n_unknown) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {7: ("", 2)} | {k: (f, n) for k, (_, f, n) in enumerate(STRANGE)}
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_archives(spark):
    rows = [(3, "http://a/b c", "<p>x</p>\r\n\r\nWARC/1.1"), (1, "u", "<p>x</p>\r\n\r\nWARC/1.1"), (2, None, None), (5, "v", ""), (5, "v", ""), (None, "w", "é")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [tuple(r) for r in warc.read_pages(warc.convert(warc.arc_archives(pages))).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted([(1, 20, "response", None), (3, 20, "revisit", 1), (2, 0, "response", None), (5, 0, "revisit", 2),
                                           (5, 0, "revisit", 2), (None, 2, "response", None)], key=str)
    assert warc.read_pages(warc.convert(warc.arc_archives(pages.filter("page_id is null")))).count() == 1
    assert warc.read_pages(warc.convert(warc.arc_archives(pages.filter("false")))).count() == 0


def test_archives_of_others(spark, tmp_path):
    """Archives as crawlers wrote them: bytes of any kind, records without HTTP header, plain or gzipped."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n"
    image = b"HTTP/1.0 200 OK\r\nX-Page-Id: none\r\n\r\n\x89PNG\r\n\x1a\n\x00\xff\xfe" + bytes(range(256))
    records = [  # URL, IP, date, content type, block, WARC type, payload
        (b"http://a/caf\xe9", "192.0.2.1", "20010203040506", "text/html", head + "caf\xe9".encode("latin-1"), "response", b"caf\xe9"),
        (b"http://a/i.png", "192.0.2.2", "20010203040507", "image/png", image, "response", image.split(b"\r\n\r\n", 1)[1]),
        (b"dns:a", "192.0.2.3", "20010203040508", "text/dns", b"20010203\na. 60 IN A 192.0.2.1\n", "resource", b"20010203\na. 60 IN A 192.0.2.1\n"),
        (b"http://a/bare", "192.0.2.4", "20010203040509", "text/html", b"HTTP/1.0 200 OK\nA: b\n\n<p>\r\n\r\n", "response", b"<p>\r\n\r\n"),
        (b"http://a/old page", "0.0.0.0", "20010203040510", "no-type", b"<html>0.9</html>", "resource", b"<html>0.9</html>"),
        (b"http://a/none", "192.0.2.6", "20010203040511", "text/html; charset=x", b"HTTP/1.1 204 None\r\nA: b", "response", b""),
        (b"http://b/again", "192.0.2.7", "20010203040512", "text/html", b"HTTP/1.0 200 OK\r\n\r\ncaf\xe9", "revisit", b"caf\xe9"),
    ]
    parts = [warc.arc_header("1", "x.arc")]
    parts += [b"%s %s %s %s %d\n%s\n" % (u, ip.encode(), d.encode(), mime.encode(), len(b), b) for u, ip, d, mime, b, _, _ in records]
    for name, data in (("x.arc", b"".join(parts)), ("x.arc.gz", b"".join(map(gzip.compress, parts)))):
        (tmp_path / name).write_bytes(data)
        arcs = spark.read.format("binaryFile").load(str(tmp_path / name)).select("path", "content")
        files = warc.convert(arcs).cache()
        whole = b"".join(gzip.decompress(r.content) for r in files.collect())
        got = {h["warc-date"][17:19]: (h, b) for h, b in warc.read_warc(whole) if h["warc-type"] != "warcinfo"}
        assert len(got) == len(records) and whole.endswith(b"\r\n\r\n")
        twice = {got["06"][0]["warc-type"], got["12"][0]["warc-type"]}
        assert twice == {"response", "revisit"}  # which of two is the response is by record id
        for _, ip, d, mime, block, kind, payload in records:
            h, b = got[d[12:]]
            assert h.get("warc-ip-address") == (None if ip == "0.0.0.0" else ip)
            assert h["warc-payload-digest"] == f"sha1:{warc.digest(payload)}"
            if d[12:] not in ("06", "12"):
                assert h["warc-type"] == kind and b == block
            assert h.get("content-type") == ("application/http; msgtype=response" if kind != "resource" else mime if "/" in mime else None)
        assert got["06"][0]["warc-target-uri"] == "http://a/caf%E9" and got["10"][0]["warc-target-uri"] == "http://a/old%20page"
        assert sorted(r.payload_bytes for r in warc.read_pages(files).collect()) == sorted(len(r[-1]) for r in records)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, path = docs, str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == before.columns and docs.join(before, "doc_id", "left_anti").count() == 0
        assert docs.count() > 0.5 * before.count()
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == docs.count()
    assert docs.agg(F.sum("n_chars")).first()[0] > 0


def test_suffix_dedup_of_two_texts_on_one_id(spark):
    """Rows of one doc_id and other texts lose only what a smaller doc_id has; equal rows are one document."""
    draw = random.Random(9)
    a, b, c = (" ".join(draw.choices(WORDS, k=40)) for _ in range(3))
    rows = [(0, a), (1, f"{a} and more"), (1, f"other {b}"), (1, f"other {b}"), (1, f"{b} again"), (2, f"{b} {c}"), (3, c), (2, c[:60])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect())

    def left(k, text):
        raw = text.encode()
        seen = {t.encode()[i : i + 50] for d, t in rows if d < k for i in range(len(t.encode()) - 49)}
        gone = {j for i in range(len(raw) - 49) if raw[i : i + 50] in seen for j in range(i, i + 50)}
        return bytes(x for i, x in enumerate(raw) if i not in gone)

    assert got == sorted((k, left(k, t)) for k, t in rows)
    assert (1, f"other {b}".encode()) in got


def test_suffix_dedup_shuffles_packed_texts(spark):
    """Texts are packed when they are shuffled (F1) and come back as they were, empty and long ones too."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = ["", "\u00e9t\u00e9 \U0001f600", *(" ".join(words[(k * j + j) % 8] for j in range(40 * k)) for k in range(1, 60))]
    docs = spark.createDataFrame([(k, t, k % 3) for k, t in enumerate(texts)], "doc_id bigint, text string, tag int").repartition(3)
    pressed = suffix_dedup._pressed(docs)
    assert sum(len(r.text) for r in pressed.collect()) < sum(len(t) for t in texts) / 2
    back = pressed.mapInArrow(suffix_dedup._plain, docs.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
    plan = suffix_dedup.suffix_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2
