"""License scans (8): a multinomial regression over the n-grams of paragraphs tells families, templates confirm them.

DataFrame and SQL functions and Spark's own models only. The words around each licence word of a paragraph or line go to a
sparse multinomial logistic regression whose classes are the families, ``unknown`` (a notice of some other licence) and
``none`` (no notice: "The MIT License was written in 1988."). Names are features of it, as they stand and once more under one
mark that all of them share. A family whose probability reaches a threshold, calibrated on wordings that the model of that
time had not seen, is taken when a template of it is there too; a notice that no template confirms is unknown.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The mark that stands for a name.
MARK = "xname"
_GPL = r"(?:general public license|gpl)"
_FSF = r"(?: as published by the free software foundation)?(?: either)?"


def _v(number: str) -> str:
    """A version behind a name; ".0" may be left out."""
    whole = number.removesuffix(".0").replace(".", r"\.")
    return rf"(?: version| v)? ?v?{whole}(?:\.0)?" if number.endswith(".0") else rf"(?: version| v)? ?v?{whole}"


def _cc() -> dict[str, str]:
    words = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    kinds = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
    return {f"cc-{k}-{v}": rf"(?:(?:cc|creative commons) )?(?:(?:cc|creative commons|creativecommons.org licenses) {k.replace('-', ' ')}|attribution{''.join(' ' + words[x] for x in k.split('-')[1:])})(?: license)?{_v(v)}"
            for k in kinds for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}


#: Templates of names by family, over lower-case words parted by single blanks. A family outside this list is unknown.
NAMES: dict[str, str] = {
    **{f"apache-{v}": rf"(?:apache(?: software)? license{_v(v)}|apache{_v(v)}|apache.org licenses license {v.replace('.', chr(92) + '.')})" for v in ("1.1", "2.0")},
    "mit": r"(?:mit licensed?|opensource.org licenses mit|(?:(?<=identifier )|(?<=under )|(?<=under the )|(?<=licensed? ))mit)",
    **{f"gpl-{v}": rf"(?<!lesser )(?<!library )(?<!affero )(?:gnu )?{_GPL}{_FSF}{_v(v)}" for v in ("2.0", "3.0")},
    **{f"lgpl-{v}": rf"(?:(?:gnu )?(?:lesser|library) {_GPL}|(?:gnu )?lgpl){_FSF}{_v(v)}" for v in ("2.0", "2.1", "3.0")},
    "agpl-3.0": rf"(?:(?:gnu )?affero {_GPL}|(?:gnu )?agpl){_FSF}{_v('3.0')}",
    **_cc(),
    "cc0-1.0": r"(?:(?:creative commons )?cc0|creative commons zero)(?: (?:license )?(?:v|version )?1\.0)?(?: universal)?",
    **{f"bsd-{n}-clause": rf"(?:bsd {n} clause|(?:{n}|{w}) clause bsd)(?: license)?" for n, w in ((2, "two"), (3, "three"), (4, "four"))},
    **{f"mpl-{v}": rf"(?:mozilla public license|mpl){_v(v)}" for v in ("1.1", "2.0")},
    **{f"epl-{v}": rf"(?:eclipse public license|epl){_v(v)}" for v in ("1.0", "2.0")},
    "eupl-1.2": rf"(?:european union public license|eupl){_v('1.2')}",
    "cddl-1.0": rf"(?:common development and distribution license|cddl){_v('1.0')}",
    "artistic-2.0": rf"artistic license{_v('2.0')}",
    "bsl-1.0": rf"boost software license{_v('1.0')}",
    "isc": r"(?:isc license|(?<=identifier )isc)",
    "zlib": r"(?:zlib license|(?<=identifier )zlib)",
    "unlicense": r"(?:the unlicense|(?<=identifier )unlicense)",
}
#: Texts that do not name their licence, by family.
BODIES: tuple[tuple[str, str], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
#: Share of a template's runs of three words that a text must contain.
CONTAINED = 0.6
#: Wordings of notices, and sentences that speak of a licence without granting one.
NOTICES = (
    "this project is licensed under the terms of the xname", "this software is distributed under the xname", "the code is available under the xname",
    "available under xname", "this file is subject to the terms of the xname", "subject to the xname", "you may use this work under the xname",
    "it is released under xname", "the source is released under the terms of the xname", "published under the xname", "spdx license identifier xname",
    "license xname", "licensed under a xname", "all content is licensed under a xname international license", "you can redistribute it and or modify it under the terms of the xname",
    "provided under xname", "made available under the terms of xname", "covered by the xname", "is xname", "licensed under either xname or",
    "you may obtain a copy of the license at http www xname", "use of this source code is governed by the xname", "this document is xname", "shared under the xname",
    "dual licensed under xname and", "copyright 2020 the authors xname", "this library is free software under the xname", "xname see license file for details", "distributed under xname",
    "this code is free to use under the xname", "released under the terms of the xname", "this package is licensed under xname", "usage is governed by the xname", "it is offered under the xname",
    "use is granted under the xname", "this file is part of a program that is licensed under the xname", "the text is available under the xname", "contents are covered by the terms of the xname",
)
PAIRS = ("licensed under either {} or {}", "dual licensed under {} and {}", "available under the terms of the {} or the {}")
OTHERS = (
    "the xname was written in 1988", "the xname is a short permissive license", "she compared the xname with others", "many projects prefer the xname", "he read about the xname in a book",
    "the court discussed the xname at length", "the difference between the xname and the other is small", "what is the xname", "critics of the xname say that it is too long",
    "this file is not licensed under the xname", "it is no longer available under the xname", "xname was published in 2007", "they moved away from the xname", "an article on the history of xname",
    "the talk explains why the xname matters", "lawyers argue over the xname", "the xname differs from the older version", "the authors of the xname met in boston", "a student asked about xname",
    "this work was never released under the xname", "the xname has been translated into many languages", "not covered by the xname", "the foundation wrote the xname", "the xname became popular in the nineties",
    "he prefers the xname to others", "critics dislike the xname", "a history of the xname", "it explains what the xname means", "the xname is longer than most", "a talk about the xname", "people argue about the xname",
    "we compared the xname with the old one", "the xname is not used here", "this is not under the xname", "the book on the xname is out", "the xname was first written by a lawyer",
)
#: Fixed value: what every notice has; only texts with it are read further. "mit" alone is a German word.
STEMS = r"(?i)(?:licen[cs]|permission|redistribut|apache|gpl|mozilla|\bmpl|\bepl|\beupl|\bcddl|\bbsd|under\s+(?:the\s+)?mit\b|creative\s*commons|spdx|\bcc[ -]by|\bcc0|public\s+domain|implied\s+warranty)"
WORD = r"[^a-z0-9.+]+"
#: Words that a window is made around, and how many words on either side of them the model reads.
ANCHOR = r"^(?:(?:un|re|sub)?licen[cs]|[la]?gpl|apache(?:\.org)?$|bsd$|mit$|mozilla$|mpl|epl|eupl|cddl|creative|cc$|cc0|isc$|zlib$|permi|redistribut|domain$|warrant)"
NEAR = 10
#: The classes that are no family: a notice of another licence, and no notice.
UNKNOWN, NONE = "unknown", "none"
#: Licences outside the families, which the model learns as unknown, and sentences of other licences as none.
STRANGERS = (
    "postgresql license", "python software foundation license version 2", "wtfpl", "gnu free documentation license version 1.3", "sil open font license version 1.1",
    "microsoft public license", "zope public license 2.1", "open database license 1.0", "academic free license version 3.0", "server side public license version 1",
    "artisan works license version 7", "acme home license", "northern tools license 4.1", "house license version 5", "gnu general public license", "creative commons license", "apache license version 9",
    "sample license version 7", "license version 6", "vendor license",
)
PLAIN = (
    "she lost her driving license", "a fishing license is needed at the lake", "his license was taken away", "the license fee went up", "permission to leave was denied", "they asked for permission to build",
    "the apache helicopter landed", "he studied at mit in boston", "a creative person", "the public domain of the king", "license plates are made of tin", "you need a license for that", "the warranty has run out",
    "the shop sells beer under license", "goods were redistributed among the poor", "dogs need a license in this town", "the driver had no license", "she got the license in may",
)
#: Wordings of which one in so many is kept back while the threshold is chosen, and the thresholds that are tried.
HELD_OUT = 4
THRESHOLDS = [k / 20 for k in range(1, 19)]
#: Strength of the regression's penalty, the part of it that makes weights zero, and its rounds.
REGULAR, SPARSE, ROUNDS = 0.0003, 0.1, 40


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\") + "'"


def _plain(text: str) -> str:
    """SQL: lower-case words without closing points, parted by single blanks, in one spelling of licence."""
    return f"array_join(filter(transform(split(replace(lower({text}), 'licence', 'license'), '{WORD}'), w -> trim(BOTH '.' FROM w)), w -> w != ''), ' ')"


def _spellings() -> dict[str, tuple[str, ...]]:
    """Names by family, as ``_plain`` leaves them, that the model learns."""
    words = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    out: dict[str, tuple[str, ...]] = {}
    for family in NAMES:
        stem, _, v = family.rpartition("-")
        short = v.removesuffix(".0")
        if family.startswith("cc-"):
            kinds = stem.removeprefix("cc-").split("-")
            whole = " ".join(words[k] for k in kinds)
            out[family] = (f"cc {' '.join(kinds)} {v}", f"creative commons {whole} {v}", f"creative commons {whole} license version {v}", f"creativecommons.org licenses {' '.join(kinds)} {v}")
        elif stem == "apache":
            out[family] = (f"apache license version {v}", f"apache license {v}", f"apache {v}", f"apache software license version {v}", f"apache.org licenses license {v}")
        elif stem in ("gpl", "lgpl", "agpl"):
            kind = {"gpl": "", "lgpl": "lesser ", "agpl": "affero "}[stem]
            out[family] = (
                f"gnu {kind}general public license version {short}", f"gnu {kind}general public license v{v}", f"{stem} {v}", f"gnu {stem} version {short}", f"{stem} v{short}", f"{stem}v{short}",
                f"gnu {kind}general public license as published by the free software foundation either version {short}")
        elif stem.startswith("bsd"):
            n = stem.removeprefix("bsd-")
            out[family] = (f"bsd {n} clause license", f"bsd {n} clause", f"{ {'2': 'two', '3': 'three', '4': 'four'}[n]} clause bsd license", f"{n} clause bsd license")
        elif stem in ("mpl", "epl", "eupl", "cddl", "artistic", "bsl"):
            whole = {"mpl": "mozilla public license", "epl": "eclipse public license", "eupl": "european union public license", "cddl": "common development and distribution license",
                     "artistic": "artistic license", "bsl": "boost software license"}[stem]
            out[family] = (f"{whole} version {v}", f"{whole} {v}", f"{whole} v{short}", *([f"{stem} {v}"] if stem not in ("artistic", "bsl") else []))
    out |= {"mit": ("mit license", "mit", "opensource.org licenses mit"), "cc0-1.0": ("cc0 1.0", "cc0", "creative commons zero", "cc0 1.0 universal"), "isc": ("isc license",),
            "zlib": ("zlib license",), "unlicense": ("the unlicense", "unlicense")}
    return out


def _runs(words: str, n: int) -> str:
    return f"transform(sequence(0, greatest(size({words}) - {n}, 0)), i -> array_join(slice({words}, i + 1, {n}), ' '))"


def _bounded(pattern: str) -> str:
    return rf"(?<![^ ])(?:{pattern})(?![^ ])"


def _grams(text: str) -> str:
    """SQL: distinct 1- to 3-grams of the words, as they stand and with every name under one mark."""
    masked = f"regexp_replace({text}, {_quoted(_bounded('|'.join(NAMES.values())))}, '{MARK}')"
    return f"array_distinct(flatten(transform(array(split({text}, ' '), split({masked}, ' ')), w -> concat({', '.join(_runs('w', n) for n in (1, 2, 3))}))))"


def _windows(text: str) -> str:
    """SQL: for each licence word of a plain text the words near it."""
    at = f"filter(transform(w, (x, i) -> if(x rlike {_quoted(ANCHOR)}, i, -1)), i -> i >= 0)"
    return f"array_distinct(flatten(transform(array(split({text}, ' ')), w -> transform({at}, i -> array_join(slice(w, greatest(i - {NEAR}, 0) + 1, least(i, {NEAR}) + {NEAR} + 1), ' ')))))"


def wordings() -> list[tuple[str, str, str, int]]:
    """(text, family or class, name in it, number of the wording): what the model learns.

    Each name stands in some of the wordings, other names in others, so that all meet all families.
    """
    names = [(f, n) for f, spelled in _spellings().items() for n in spelled]
    rows: list[tuple[str, str, str, int]] = []
    for k, (family, name) in enumerate([*names, *((UNKNOWN, n) for n in STRANGERS)]):
        every = family == UNKNOWN
        rows += [(NOTICES[i].replace(MARK, name), family, name, i) for i in ((k + 4 * j) % len(NOTICES) for j in range(len(NOTICES) if every else 8))]
        rows += [(OTHERS[i].replace(MARK, name), NONE, name, i) for i in ((k + 5 * j) % len(OTHERS) for j in range(8))]
    first = [(f, spelled[k % len(spelled)]) for k, (f, spelled) in enumerate(_spellings().items())]
    for k, one in enumerate(first):  # a text of two licences is one of either, so both get half of the probability
        two = first[(k + 7) % len(first)]
        rows += [(text.format(one[1], two[1]), f, n, -1) for text in PAIRS for f, n in (one, two)]
    for family, body in BODIES:
        cut = body.split()
        rows += [(" ".join(cut[i : i + 2 * NEAR + 1]), family, "", i) for i in range(0, max(1, len(cut) - NEAR), 3) for _ in range(2)]
    return [*rows, *((t, NONE, "", i) for i, t in enumerate(PLAIN))]


def classes() -> list[str]:
    return [*NAMES, *sorted({f for f, _ in BODIES} - set(NAMES)), UNKNOWN, NONE]


def _fitted(rows: DataFrame) -> PipelineModel:
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(rows)
    model = LogisticRegression(family="multinomial", regParam=REGULAR, elasticNetParam=SPARSE, maxIter=ROUNDS).fit(counts.transform(rows).coalesce(1))
    return PipelineModel([counts, model])


def _scored(windows: DataFrame, model: PipelineModel) -> DataFrame:
    """``windows`` (window, unit, ...) with ``likely``, the families (family, p, confirmed), and ``notice``.

    A name's template has to stand in the window, a body's has to be there for the most part in the unit around it.
    Where no notice is more likely than all else together there are no families; ``notice`` is whether any other class comes first.
    """
    known = [f for f in classes() if f not in (UNKNOWN, NONE)]
    patterns = ", ".join(_quoted(_bounded(NAMES[f])) if f in NAMES else "cast(null as string)" for f in known)
    bodies = {f: sorted({" ".join(w[i : i + 3]) for w in [b.split()] for i in range(len(w) - 2)}) for f, b in BODIES}
    runs = ", ".join(f"array({', '.join(map(_quoted, bodies[f]))})" if f in bodies else "cast(null as array<string>)" for f in known)
    named = "coalesce(window rlike t.pattern, false)"
    bodily = f"coalesce(size(filter(t.runs, r -> instr(unit, r) > 0)) >= {CONTAINED!r}D * size(t.runs), false)"
    scored = model.transform(windows.withColumn("grams", F.expr(_grams("window")))).withColumn("p", vector_to_array("probability"))
    templates = f"zip_with(array({', '.join(map(_quoted, known))}), zip_with(array({patterns}), zip_with(array({runs}), slice(p, 1, {len(known)}), (r, p) -> struct(r as runs, p as p)), (x, y) -> struct(x as pattern, y.runs as runs, y.p as p)), (f, y) -> struct(f as family, y.pattern as pattern, y.runs as runs, y.p as p))"
    likely = f"transform(filter({templates}, t -> t.p >= {THRESHOLDS[0]!r}D and p[{len(known) + 1}] < 0.5D), t -> struct(t.family as family, t.p as p, {named} or {bodily} as confirmed))"
    return scored.withColumns({"likely": F.expr(likely), "notice": F.expr(f"prediction != {len(known) + 1}D")}).drop("grams", "features", "rawPrediction", "probability", "prediction", "p")


def held_out_counts(found: list, threshold: float) -> tuple[int, int, int]:
    """Families found rightly, found, and there, in rows (family, likely)."""
    taken = [(r.family, {x.family for x in r.likely if x.confirmed and x.p >= threshold}) for r in found]
    return sum(f in fs for f, fs in taken), sum(len(fs) for _, fs in taken), sum(f not in (UNKNOWN, NONE) for f, _ in taken)


def trained(spark: SparkSession) -> tuple[PipelineModel, float]:
    """The model over all wordings, and the threshold that did best on wordings that another model had not seen."""
    labels = {f: float(k) for k, f in enumerate(classes())}
    texts = spark.createDataFrame([(t, f, labels[f], name, i) for t, f, name, i in wordings()], "unit string, family string, label double, name string, wording int").coalesce(1)
    rows = texts.withColumn("window", F.explode(F.expr(_windows("unit")))).filter("instr(window, name) > 0").distinct().coalesce(1)
    rows = rows.withColumn("grams", F.expr(_grams("window"))).persist()
    held = f"name != '' and wording % {HELD_OUT} = 1"
    found = _scored(rows.filter(held).select("window", "unit", "family"), _fitted(rows.filter(f"not ({held})"))).select("family", "likely").collect()
    model = _fitted(rows)
    rows.unpersist()

    def f1(threshold: float) -> float:
        right, taken, there = held_out_counts(found, threshold)
        return 2 * right / max(1, taken + there)

    return model, max(THRESHOLDS, key=lambda t: (round(f1(t), 4), t))


def license_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, n_licensed, n_unknown, families) of the paragraphs, parted by blank lines, with a licence word.

    Each line is a unit of its own, and so is the whole of a paragraph of several lines: a notice that runs over line
    breaks is found there, and only its families that no single line has count, as one unit more. ``n_unknown`` counts
    the lines with a notice of which no family was confirmed, or else the whole paragraph if it has one; none where the
    whole paragraph told a family that its lines did not.
    """
    model, threshold = trained(docs.sparkSession)
    row = F.monotonically_increasing_id().alias("row")
    parts = docs.select("doc_id", row, F.posexplode(F.split("text", r"\n[ \t\r]*\n")).alias("paragraph", "block")).filter(F.col("block").rlike(STEMS))
    lines = r"transform(split(block, '\n'), x -> if(x rlike " + _quoted(STEMS) + f", {_plain('x')}, ''))"
    units = parts.select("doc_id", "row", "paragraph", F.posexplode(F.expr(f"if(instr(block, '\\n') > 0, concat(array({_plain('block')}), {lines}), array('', {_plain('block')}))")).alias("line", "unit"))
    windows = units.withColumn("window", F.explode(F.expr(_windows("unit"))))
    taken = f"transform(filter(likely, x -> x.confirmed and x.p >= {threshold!r}D), x -> x.family)"
    judged = _scored(windows, model).select("doc_id", "row", "paragraph", "line", F.expr(taken).alias("taken"), "notice")
    by_line = judged.groupBy("doc_id", "row", "paragraph", "line").agg(F.array_distinct(F.flatten(F.collect_set("taken"))).alias("taken"), F.max("notice").alias("notice"))
    whole, single = F.col("line") == 0, F.col("line") > 0
    licensed, unknown = F.size("taken") > 0, F.col("notice") & (F.size("taken") == 0)
    found = by_line.groupBy("doc_id", "row", "paragraph").agg(
        F.array_distinct(F.flatten(F.collect_set(F.when(whole, F.col("taken"))))).alias("_whole"), F.array_distinct(F.flatten(F.collect_set(F.when(single, F.col("taken"))))).alias("_single"),
        F.count_if(single & licensed).alias("n_lines"), F.count_if(single & unknown).alias("_lines"), F.count_if(whole & unknown).alias("_block"))
    more = F.size(F.array_except("_whole", "_single")) > 0
    return found.select("doc_id", "paragraph", (F.col("n_lines") + more.cast("bigint")).alias("n_licensed"),
                        F.when(more, F.lit(0)).when(F.col("n_lines") > 0, F.col("_lines")).otherwise(F.greatest("_lines", "_block")).cast("bigint").alias("n_unknown"), F.array_union("_whole", "_single").alias("families"))


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, n_licensed, families, n_unknown) for every row; families are distinct, sorted, comma-joined.

    ``n_paragraphs`` counts lines with a non-blank character, ``n_licensed`` those with a notice of a family, and one more for
    each paragraph that has one over line breaks; ``n_unknown`` counts notices of other licences. Null and empty texts have
    none. Rows that repeat a doc_id, or have none, are counted together and each given the sum. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    found = license_paragraphs(docs).groupBy("doc_id").agg(
        F.sum("n_licensed").alias("n_licensed"), F.sum("n_unknown").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("families"))
    sizes = docs.select("doc_id", F.expr(r"coalesce(size(filter(split(text, '\n'), x -> x rlike '\\S')), 0)").cast("bigint").alias("n_paragraphs"))
    joined = sizes.join(found.withColumnRenamed("doc_id", "id"), F.expr("doc_id <=> id"), "left")
    none = F.lit(0).cast("bigint")
    return joined.select("doc_id", "n_paragraphs", F.coalesce("n_licensed", none).alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_unknown", none).alias("n_unknown"))
