"""Line dedup against an exact join of all lines."""

import random

from ridgecast.llm import line_dedup

LETTERS = "abcdefghijklmnop"


def similar(x, y):
    s, t = ({z[i : i + 5] for i in range(max(1, len(z) - 4))} for z in (x, y))
    return 100 * len(s & t) >= 80 * len(s | t)


def plain(rows):
    """(doc_id, text) -> text without the lines that repeat an earlier one of their component; every pair of lines is compared."""
    spots = sorted({(d, line_dedup_print(t), k, x) for d, t in rows if t for k, x in enumerate(t.split("\n")) if x.strip()})
    names = sorted({x for *_, x in spots})
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            if similar(x, y):
                root[find(x)] = find(y)
    seen, gone = set(), set()
    for d, p, k, x in spots:
        if find(x) in seen:
            gone.add((d, p, k))
        seen.add(find(x))
    return {(d, t): "\n".join(x for k, x in enumerate(t.split("\n")) if (d, line_dedup_print(t), k) not in gone) for d, t in rows if t}


def line_dedup_print(text):
    """The order of two texts of one doc_id, as Spark's prints have it."""
    return line_dedup.line_key(text.encode())


def documents(seed):
    draw = random.Random(seed)

    def line(n):
        return "".join(draw.choice(LETTERS + "  ") for _ in range(n)).strip() or "x"

    base = [line(draw.choice([3, 8, 30, 80, 200])) for _ in range(60)]
    rows = []
    for d in range(40):
        parts = []
        for _ in range(draw.randint(0, 6)):
            x = draw.choice(base) if draw.random() < 0.6 else line(60)
            if draw.random() < 0.5 and len(x) > 25:  # one or a few letters changed
                for _ in range(draw.randint(1, max(1, len(x) // 60))):
                    k = draw.randrange(len(x))
                    x = x[:k] + draw.choice("XYZ") + x[k + 1 :]
            parts.append(x)
        rows.append((d, "\n".join(parts)))
    return rows


def test_lines_equal_the_exact_join(spark):
    for seed in (1, 2):
        rows = documents(seed)
        want = plain(rows)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        kept = {(r.doc_id, i): r.text for r in line_dedup.line_dedup(docs).collect() for i in (dict(rows)[r.doc_id],)}
        assert {k: v for k, v in kept.items() if k[1]} == want


def test_two_texts_on_one_id(spark):
    rows = [(1, "L one line that repeats\nU stays here"), (1, "V is another\nL one line that repeats"), (2, "L one line that repeats"), (1, "V is another\nL one line that repeats")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(r.text for r in line_dedup.line_dedup(docs).collect())
    assert "\n".join(got).count("U stays here") == 1 and "\n".join(got).count("V is another") == 2
    assert got.count("") == 1 and "\n".join(got).count("L one line") in (1, 2)  # rows that are wholly equal are one occurrence
    unrelated = spark.createDataFrame([(1, "a line of its own\nsecond"), (1, "nothing in common\nthird")], "doc_id bigint, text string")
    assert {r.n_removed for r in line_dedup.line_dedup(unrelated).collect()} == {0}


def test_clashing_names_and_long_texts(spark):
    long = "\n".join(f"{'word ' * 4000}{k}" for k in range(3)) + "\n" + "\n".join("ab" for _ in range(20_000))
    docs = spark.createDataFrame([(1, long, 5, "x"), (2, None, 6, "y"), (3, "", 7, "z")], "doc_id bigint, text string, _p int, gone string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[1]._p == 5 and got[1].gone == "x" and got[1].n_lines == 20_003 and got[1].n_removed == 19_999
    assert got[2].text is None and got[3].text == ""


def test_recall_of_the_bands():
    draw = random.Random(7)
    pairs = hit = 0
    for _ in range(600):
        x = "".join(draw.choice(LETTERS) for _ in range(draw.choice([60, 150, 400])))
        y = list(x)
        for k in draw.sample(range(len(x)), max(1, len(x) // 60)):
            y[k] = "Z"
        y = "".join(y)
        if similar(x, y):
            pairs += 1
            p, q = line_dedup.band_prints([x, y])
            hit += bool((p == q).any())
    assert pairs > 300 and hit >= 0.99 * pairs
