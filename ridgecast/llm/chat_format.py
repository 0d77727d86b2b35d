"""Chat formatting (3): records of several layouts become canonical turns, and turns a reversible template.

A record's layout is told by its fingerprint, the hash of its nested field paths; each fingerprint selects a
declarative mapping from paths to roles.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The layouts. A mapping lists (role, path) in the order of turns; ``[]`` stands for each element of a
#: list, and a role that begins with ``@`` is read from that path of the same element. ``?`` marks fields that may be absent.
LAYOUTS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("@role", "text"),),
    (("@messages[].role", "messages[].content"),),
    (("@conversations[].from", "conversations[].value"),),
    (("system?", "system"), ("user", "prompt"), ("assistant", "response")),
    (("system?", "system"), ("user", "instruction"), ("user?", "input"), ("assistant", "output")),
    (("system?", "system"), ("user", "question"), ("assistant", "answer")),
)
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"

_escape = re.compile(r"[\\#<:]")
_unescape = re.compile(r"\\(.)", re.DOTALL)
_turn = re.compile(r"### ((?:[^\\:]|\\.)*): (.*) </turn>\n", re.DOTALL)


def paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(field_paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


def mappings() -> dict[str, tuple[tuple[str, str], ...]]:
    """Fingerprint to mapping, for each layout with and without each field that may be absent."""
    out = {}
    for layout in LAYOUTS:
        maybe = [k for k, (role, _) in enumerate(layout) if role.endswith("?")]
        for mask in range(1 << len(maybe)):
            absent = {k for bit, k in enumerate(maybe) if mask >> bit & 1}
            used = tuple((role.rstrip("?"), path) for k, (role, path) in enumerate(layout) if k not in absent)
            out[fingerprint({p for role, path in used for p in ({path} | ({role[1:]} if role[0] == "@" else set()))})] = used
    for name in ("messages", "conversations"):  # a list without elements has no turns
        out[fingerprint({f"{name}[]"})] = ()
    return out


_mappings = mappings()


def canonical(record: dict) -> list[tuple[str, str]] | None:
    """Turns (role, text) of a record, or None for a layout that no mapping declares. Nulls are empty."""
    mapping = _mappings.get(fingerprint(paths(record)))
    if mapping is None:
        return None
    turns = []
    for role, path in mapping:
        if "[]" in path:
            items, field = path.split("[].")
            turns += [(e.get(role.rpartition(".")[2]), e.get(field)) for e in record[items]]
        else:
            turns.append((record[role[1:]] if role[0] == "@" else role, record[path]))
    return [(ROLES.get(r, r) or "", t or "") for r, t in turns]


def escaped(text: str) -> str:
    """Each backslash and each character that could begin a mark behind a backslash; ``unescaped`` undoes it."""
    return _escape.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _unescape.sub(r"\1", text)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where in it the loss applies: the text of an assistant's turn, nothing of others."""
    head = OPEN + escaped(role) + MIDDLE
    body = escaped(text)
    return head + body + CLOSE, len(head), len(body) if role == "assistant" else 0


def parsed_turn(formatted: str) -> tuple[str, str]:
    role, body = _turn.fullmatch(formatted).groups()
    return unescaped(role), unescaped(body)


def format_chats(records: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, part, formatted, loss_start, loss_length) from records (conv_id, turn, record as JSON).

    A conversation is the text of its rows in the order of (turn, part). Records may be one turn each or whole
    conversations. A null record or one of an undeclared layout gives a row with a null ``formatted``, so
    nothing is lost unseen. Null roles and texts are empty. Rows are formatted where they are, in one narrow pass,
    however many of them one conversation has.
    """
    schema = "conv_id bigint, turn bigint, part int, formatted string, loss_start int, loss_length int"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = canonical(json.loads(record)) if record is not None else None
                if turns is None:
                    rows.append((conv, turn, 0, None, None, None))
                else:
                    rows += [(conv, turn, part, *formatted_turn(*t)) for part, t in enumerate(turns)]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=["conv_id", "turn", "part", "formatted", "loss_start", "loss_length"])

    return records.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "record").mapInArrow(work, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted rows say: turns, digests, and the text under the loss mask.

    The rows of a partition come in order and are read one by one, so a conversation of any length needs no
    more memory than a row; its digest is sequential by nature. Rows without a ``formatted`` are left out.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            conv, n, turns, chars, loss, total = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                               names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return batch

        for batch in batches:
            for conv, text, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parsed_turn(text)
                under = unescaped(text[start : start + length])
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(under)
                state[4].update(under.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if done:
                yield flush()
        if state is not None:
            close()
        yield flush()

    rows = formatted.filter("formatted is not null").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "formatted")
    return rows.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(work, schema)
