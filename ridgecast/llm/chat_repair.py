"""Conversation structure repair (11): the lightest derivation of a well-formed conversation, by Knuth's agenda.

Items are stretches of rows with the state of the role pattern before and behind them, and a value (cost, audit).
Axioms say what one row may become and what may be put between rows; a deduction joins a prefix with the step
behind it, adds costs and puts audits one after the other. Items leave the agenda by cost, then end, then start, then
audit. No deduction gives a smaller key than its parts have, so an item is final when it leaves, and the first goal
that does is the cheapest repair, the least in ASCII order among equals.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgecast.llm import tables
from ridgecast.llm.placed import numbered
from ridgecast.session import cut_lineage

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: States of ``(s?(ua)+)?``: nothing yet, behind s, behind u, behind a; what the next initial leads to.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, DONE = range(4), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Conversations with more rows are repaired in blocks of so many.
BLOCK = 256
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""


def fault(text: str, seen: bool) -> str:
    """A row's first fault."""
    rest = text.rstrip(SPACE)
    if not rest:
        return BLANK
    return DUPLICATE if seen else SOUND if rest[-1] in ENDS else TRUNCATED


def axioms(rows: list[tuple[str, str]]) -> Iterator[tuple[int, int, int, int, int, str]]:
    """(cost, start, end, state before, state behind, edit) of all that rows (initial, fault) and the gaps between them may become."""
    for j, (initial, wrong) in enumerate(rows):
        for q in STATES:
            yield DELETE, j, j + 1, q, q, "D"
        if wrong not in (BLANK, DUPLICATE):
            more = CUT_OFF if wrong == TRUNCATED else 0
            for (q, role), r in STEP.items():
                if role == initial:
                    yield KEEP + more, j, j + 1, q, r, "K"
                if role in ROLES:
                    yield REROLE + more, j, j + 1, q, r, "R"
    for j in range(len(rows) + 1):
        for (q, role), r in STEP.items():
            if role in ROLES:
                yield INSERT, j, j, q, r, "I"


def derive(rows: list[tuple[str, str]], starts: Iterable[int] = (0,), goal: bool = True) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state behind) to the lightest (cost, audit) over all rows; with ``goal`` only the first that leaves with the pattern done."""
    n = len(rows)
    agenda = [(cost, end, -start, edit, 1, q, r) for cost, start, end, q, r, edit in axioms(rows)]
    agenda += [(0, 0, 0, "", 0, p, p) for p in starts]
    heapq.heapify(agenda)
    final: set[tuple] = set()
    prefixes: dict[tuple[int, int], list[tuple[int, int, str]]] = {}  # by end and state behind: state before, cost, audit
    steps: dict[tuple[int, int], list[tuple[int, int, int, str]]] = {}  # by start and state before: end, state behind, cost, edit
    out: dict[tuple[int, int], tuple[int, str]] = {}
    while agenda:
        cost, end, start, audit, kind, q, r = heapq.heappop(agenda)
        item = (kind, start, end, q, r)
        if item in final:
            continue
        final.add(item)
        if kind:
            steps.setdefault((-start, q), []).append((end, r, cost, audit))
            for p, c, a in prefixes.get((-start, q), ()):
                heapq.heappush(agenda, (c + cost, end, 0, a + audit, 0, p, r))
            continue
        if end == n and (not goal or r in DONE):
            out[q, r] = cost, audit
            if goal:
                break
        prefixes.setdefault((end, r), []).append((q, cost, audit))
        for e, t, c, a in steps.get((end, r), ()):
            heapq.heappush(agenda, (cost + c, e, 0, audit + a, 0, q, t))
    return out


def _less(a: tuple, b: tuple) -> bool:
    """Whether chain a, of (chain before, audit of a block), reads less than b; the part that they share is not read."""
    x, y = [], []
    while a is not b:
        x.append(a[1])
        y.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(x)) < "".join(reversed(y))


def compose(blocks: Iterable[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """(cost, audit) of a conversation from those of its blocks, in order: the same deduction, with whole blocks as steps."""
    best: dict[int, tuple[int, tuple]] = {0: (0, ())}
    for block in blocks:
        new: dict[int, tuple[int, tuple]] = {}
        for (q, r), (cost, audit) in block.items():
            if q in best:
                value = best[q][0] + cost, (best[q][1], audit)
                if r not in new or value[0] < new[r][0] or (value[0] == new[r][0] and _less(value[1], new[r][1])):
                    new[r] = value
        best = new
    cost, chain = best.pop(DONE[0])
    if DONE[1] in best:
        other = best[DONE[1]]
        if other[0] < cost or (other[0] == cost and _less(other[1], chain)):
            cost, chain = other
    parts = []
    while chain:
        chain, part = chain
        parts.append(part)
    return cost, "".join(reversed(parts))


def repaired(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) that the edits of an audit make of rows (role, text)."""
    rows = iter(rows)
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if state == 2 else "u"]
        state = STEP[state, role[:1]]
        yield role, text


def measure(rows: list[tuple[int | None, str, str]]) -> dict:
    """Counts over a stretch of rows (turn, initial, fault) in order, and what its neighbours must know of it."""
    turns = [t for t, _, _ in rows if t is not None]
    wrong = [w for _, _, w in rows]
    pairs = zip(rows, rows[1:])
    return {
        "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)), "first": rows[0][1], "last": rows[-1][1],
        "illegal": sum(1 for a, b in pairs if a[1] + b[1] not in ("su", "ua", "au")), **{k: wrong.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)},
    }


def merged(parts: Iterable[dict]) -> dict:
    """The counts of stretches that follow one another."""
    whole: dict = {}
    for part in parts:
        if not whole:
            whole = dict(part)
            continue
        for k in ("illegal", BLANK, DUPLICATE, TRUNCATED):
            whole[k] += part[k]
        whole["illegal"] += whole["last"] + part["first"] not in ("su", "ua", "au")
        whole["last"] = part["last"]
        if part["low"] is not None:
            whole["turns"] += part["turns"] - (whole["high"] == part["low"])
            whole["low"] = part["low"] if whole["low"] is None else whole["low"]
            whole["high"] = part["high"]
    return whole


_COUNTS = ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")
SUMMARY = "grp string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
DIGEST = "repaired_sha256 string"


def _summary(grp: str, counts: dict, cost: int, audit: str) -> tuple:
    gaps = 0 if counts["low"] is None else counts["high"] - counts["low"] + 1 - counts["turns"]
    return (grp, *({**counts, "gaps": gaps, "cost": cost}[k] for k in _COUNTS), audit)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _digest(turns: Iterator[tuple[str, str]]) -> str:
    h = hashlib.sha256()
    for k, (role, text) in enumerate(turns):
        h.update(b"\n" * (k > 0) + f"{role}:{text}".encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def _stream(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a conversation one after another in one task."""
    return df.repartition(tables.partitions(df.sparkSession), "grp").sortWithinPartitions("grp", *order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of at most BLOCK rows (grp, turn, mark, role, text): all in one go."""
    schema = T.StructType.fromDDL(f"{SUMMARY}, {DIGEST}")
    out = tables.arrow(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for grp, found in groupby(_rows(batches), key=lambda r: r[0]):
            lines, seen, facts = [], set(), []
            for _, turn, mark, role, text in found:
                facts.append((turn, role[:1], fault(text, mark in seen)))
                lines.append((role, text))
                seen.add(mark)
            (cost, audit), = derive([f[1:] for f in facts]).values()
            done.append((*_summary(grp, measure(facts), cost, audit), _digest(repaired(audit, lines))))
            if len(done) >= 1000:
                yield _batch(done, out)
                done = []
        if done:
            yield _batch(done, out)

    return _stream(rows, ["turn", "mark"]).mapInArrow(work, schema)


def _block_items(rows: DataFrame) -> DataFrame:
    """(grp, block, items): what each block of placed rows (grp, nth, turn, initial, fault) measures and derives."""
    blocks = rows.select("grp", F.floor(F.col("nth") / BLOCK).alias("block"), "nth", "turn", "initial", "fault")
    dealt = blocks.repartition(tables.partitions(rows.sparkSession), "grp", "block").sortWithinPartitions("grp", "block", "nth")
    out = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("items", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, block), found in groupby(_rows(batches), key=lambda r: r[:2]):
            facts = [r[3:] for r in found]
            table = derive([f[1:] for f in facts], STATES if block else (0,), goal=False)
            items = {"counts": measure(facts), "table": [[*k, *v] for k, v in table.items()]}
            yield _batch([(grp, block, json.dumps(items))], out)

    return dealt.mapInArrow(work, "grp string, block bigint, items string")


def _long(rows: DataFrame) -> DataFrame:
    """Conversations of any length: blocks in many tasks, then one row a block, in order, for each conversation.

    Its text is read once more, in order and row by row, as the digest of a conversation asks for.
    """
    placed = cut_lineage(numbered(rows, "grp", ["turn", "mark"]))
    firsts = placed.groupBy("grp", "mark").agg(F.min("nth").alias("nth")).select("grp", "nth", F.lit(True).alias("new"))
    rest = F.rtrim(F.translate("text", SPACE[1:], " " * (len(SPACE) - 1)))
    ended = F.right(rest, F.lit(1)).isin(*ENDS)
    wrong = F.when(rest == "", BLANK).when(F.col("new").isNull(), DUPLICATE).when(~ended, TRUNCATED).otherwise(SOUND)
    facts = placed.join(firsts, ["grp", "nth"], "left").select("grp", "nth", "turn", F.substring("role", 1, 1).alias("initial"), wrong.alias("fault"))
    schema = T.StructType.fromDDL(SUMMARY)
    out = tables.arrow(schema)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, found in groupby(_rows(batches), key=lambda r: r[0]):
            counts: list[dict] = []

            def blocks() -> Iterator[dict]:
                for _, _, text in found:
                    items = json.loads(text)
                    counts[:] = [merged([*counts, items["counts"]])]
                    yield {(p, q): (cost, audit) for p, q, cost, audit in items["table"]}

            cost, audit = compose(blocks())
            yield _batch([_summary(grp, counts[0], cost, audit)], out)

    summary = cut_lineage(_stream(_block_items(facts), ["block"]).mapInArrow(join_up, schema))
    audits = summary.select("grp", F.lit(-1).cast("bigint").alias("nth"), F.lit("").alias("role"), F.col("audit").alias("text"))
    lines = audits.union(placed.select("grp", "nth", "role", "text"))
    digests = pa.schema([("grp", pa.string()), ("repaired_sha256", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, found in groupby(_rows(batches), key=lambda r: r[0]):
            audit = next(found)[3]
            yield _batch([(grp, _digest(repaired(audit, (r[2:] for r in found))))], digests)

    return summary.join(_stream(lines, ["nth"]).mapInArrow(read, f"grp string, {DIGEST}"), "grp")


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text): gaps, faults, cost, audit and digest of its cheapest repair.

    Rows stand by turn (nulls first), rows of one turn by a digest of role and text. Null roles and texts count as
    one space; rows without a conv_id are one conversation. Equal rows are duplicates. Other columns are not read. No
    rows give no conversations. ``block``: rows from which a conversation is repaired in blocks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    grp = F.coalesce(F.concat(F.lit("1"), F.col("conv_id").cast("string")), F.lit("0"))
    mark = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.select(grp.alias("grp"), F.col("turn").cast("bigint").alias("turn"), mark.alias("mark"), role.alias("role"), text.alias("text"))
    large = cut_lineage(rows.groupBy("grp").count().filter(F.col("count") > block).select("grp"))
    if not large.take(1):
        found = _short(rows)
    else:
        held = tables.maybe_broadcast(large, 64)
        found = _short(rows.join(held, "grp", "left_anti")).unionByName(_long(rows.join(held, "grp", "left_semi")))
    kind = turns.schema["conv_id"].dataType
    conv = F.when(F.col("grp") != "0", F.col("grp").substr(F.lit(2), F.length("grp")).cast(kind)).alias("conv_id")
    return found.select(conv, *_COUNTS, "audit", "repaired_sha256")
