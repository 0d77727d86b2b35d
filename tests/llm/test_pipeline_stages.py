"""The stages of the pipeline, one after another, against plain versions on planted documents."""

import random

from tests.llm.test_line_dedup import plain as plain_lines

WORDS = [a + b + c + d for a in "bdfgkm" for b in "aeiou" for c in "lnrst" for d in ("", "a", "in")]


def sentence(draw, n):
    return " ".join(draw.choices(WORDS, k=n)).capitalize() + "."


def planted():
    """(doc_id, text), the benchmark's items, and the ids of each kind."""
    draw = random.Random(12)
    items = [" ".join(draw.choices(WORDS, k=14)) for _ in range(3)]
    kinds, rows = {}, []

    def add(kind, text):
        kinds.setdefault(kind, []).append(len(rows))
        rows.append((len(rows), text))

    for _ in range(12):
        add("clean", "\n".join(sentence(draw, 30) for _ in range(3)))
    add("junk", "one two three")
    add("junk", "again and again " * 40)
    add("junk", None)
    add("junk", "\n".join("Home | News | Sport | Weather" for _ in range(12)))
    shared = sentence(draw, 25)
    for _ in range(4):
        add("lines", "\n".join((sentence(draw, 40), shared, sentence(draw, 40))))
    base = [sentence(draw, 60) for _ in range(2)]
    for text in base:
        for k in range(3):
            words = text.split()
            words[20 + k] = f"other{k}"
            add("copies", " ".join(words) + f"\n{sentence(draw, 4)}")
    for item in items:
        add("leaks", f"{sentence(draw, 40)[:-1]} {item} {sentence(draw, 40)}")
    add("leaked", f"{items[0]} {items[1]} ok then now here there.")
    return rows, items, kinds


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    """doc_id -> the smallest doc_id of its group, every pair compared."""
    root = {d: d for d, _ in rows}
    sets = {d: shingles(t or "") for d, t in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_stages_on_planted_documents(spark, tmp_path):
    import corpus_pipeline

    rows, items, kinds = planted()
    sf_dir = str(tmp_path)
    docs = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf_dir).write.parquet(f"{sf_dir}/{name}")
        before, now = now, spark.read.parquet(f"{sf_dir}/{name}")
        if name != "best_fit_packing":
            assert now.columns == before.columns
            seen.append({r.doc_id: r.text for r in now.collect()})
    quality, lines, joined, tested = seen
    assert set(quality) == {d for d, _ in rows} - set(kinds["junk"])
    assert all(quality[d] == rows[d][1] for d in quality)  # no line of these fails a rule
    assert lines == {d: t for (d, _), t in plain_lines(list(quality.items())).items()}
    first = kinds["lines"][0]
    assert lines[first] == quality[first] and all(lines[d] != quality[d] for d in kinds["lines"][1:])
    groups = plain_groups(list(lines.items()))
    assert joined == {d: t for d, t in lines.items() if groups[d] == d}
    assert set(kinds["clean"]) <= set(joined)
    assert set(tested) == set(joined) - set(kinds["leaked"])
    assert all(tested[d] == joined[d] for d in tested if d not in kinds["leaks"])
    for d in set(kinds["leaks"]) & set(tested):
        assert all(item not in tested[d] for item in items) and len(tested[d].split()) >= 75
    assert {r.doc_id for r in now.collect()} == set(tested)
    run = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert run == {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in now.collect()}
