"""Chat formatting by schema fingerprints.

A record's fingerprint is a hash of its nested field paths. It selects a declarative mapping that
turns the record's layout (turn rows, message lists, instructions, prompts) into canonical turns
of a role and a text. Turns are then written by a template whose control strings can't occur in
texts, as texts escape them reversibly, with the span of each turn that training takes a loss on.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
LOSS_ROLE = "assistant"

#: Layouts: needed and optional paths, and either the list whose elements have a role and a text,
#: or turns in order, each a role and the fields that make its text.
MAPPINGS = (
    {"name": "turn", "paths": ("role", "text"), "turns": (("@role", ("text",)),)},
    {"name": "messages", "paths": ("messages[].role", "messages[].content"), "optional": ("id",), "each": ("messages", "role", "content")},
    {"name": "conversations", "paths": ("conversations[].from", "conversations[].value"), "optional": ("id", "system"), "before": (("system", ("system",)),), "each": ("conversations", "from", "value")},
    {"name": "instruction", "paths": ("instruction", "output"), "optional": ("input", "system"), "turns": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))},
    {"name": "prompt", "paths": ("prompt", "response"), "optional": ("system",), "turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    {"name": "completion", "paths": ("prompt", "completion"), "optional": ("system",), "turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))},
    {"name": "question", "paths": ("question", "answer"), "optional": ("context",), "turns": (("user", ("context", "question")), ("assistant", ("answer",)))},
)
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a parsed record; list elements share the path `[]`."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) or {f"{at}[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def registry(mappings: tuple[dict, ...] = MAPPINGS) -> dict[str, dict]:
    """Fingerprint to mapping, with each choice of optional paths."""
    out = {}
    for m in mappings:
        extra = m.get("optional", ())
        for n in range(len(extra) + 1):
            for some in itertools.combinations(extra, n):
                out.setdefault(fingerprint({*m["paths"], *some}), m)
    return out


def canonical(record: dict, mapping: dict) -> list[tuple[str, str]]:
    """(role, text) turns. Null roles and texts are empty; an absent or null optional field makes
    no turn of its own."""

    def of(turns: tuple) -> list[tuple[str, str]]:
        out = []
        for role, fields in turns:
            given = [record[f] for f in fields if record.get(f) is not None]
            if role.startswith("@"):
                out.append((record[role[1:]] or "", "\n".join(given)))
            elif given:
                out.append((role, "\n".join(given)))
        return out

    turns = of(mapping.get("before", ())) + of(mapping.get("turns", ()))
    if "each" in mapping:
        field, role, text = mapping["each"]
        turns += [(ROLES.get(m[role], m[role]) or "", m[text] or "") for m in record[field]]
    return [(str(r), str(t)) for r, t in turns]


# Escapes: a backslash first, then what the template marks turns with.
TEXT_ESCAPE = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
ROLE_ESCAPE = TEXT_ESCAPE | {":": "\\c", "\n": "\\n"}
BACK = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":", "n": "\n"}
_text_plain, _role_plain = (re.compile("|".join(map(re.escape, e))) for e in (TEXT_ESCAPE, ROLE_ESCAPE))
_escaped = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    table = ROLE_ESCAPE if role else TEXT_ESCAPE
    return (_role_plain if role else _text_plain).sub(lambda m: table[m[0]], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: BACK[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it and the span of its text, empty for roles without loss."""
    head = f"{OPEN}{escape(role, role=True)}:\n"
    body = escape(text)
    end = len(head) + len(body)
    return head + body + CLOSE, len(head) if role == LOSS_ROLE else end, end


TURN = re.compile(re.escape(OPEN) + r"([^:\n]*):\n(.*?)" + re.escape(CLOSE), re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def canonical_turns(records: DataFrame) -> DataFrame:
    """(conv_id, turn, part, layout, role, text) from records (conv_id, turn, record JSON).

    A record whose fingerprint has no mapping, or that isn't a JSON object, gives one row with a
    null layout, role and text, so that nothing disappears unseen.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry()
        for batch in it:
            rows = []
            for conv, turn, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    record = json.loads(raw or "")
                except ValueError:
                    record = None
                mapping = known.get(fingerprint(paths(record))) if isinstance(record, dict) and record else None
                if mapping is None:
                    rows.append((conv, turn, 0, None, None, None))
                else:
                    rows += [(conv, turn, i, mapping["name"], r, t) for i, (r, t) in enumerate(canonical(record, mapping))]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "turn", "part", "layout", "role", "text"])

    return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "record").mapInArrow(run, "conv_id long, turn long, part int, layout string, role string, text string")


def formatted_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_start, loss_end) for each turn, a conversation's turns one behind
    the other in one partition; its formatted text is their concatenation.

    Order: turn (null first), part, role, text; so repeated rows and equal turn numbers have a
    defined place. A row with a null layout has an empty formatted text.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            done = [("", 0, 0) if layout is None else render(r or "", t or "") for layout, r, t in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            cols = list(zip(*done, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32()), strict=True)]], names=["conv_id", "formatted", "loss_start", "loss_end"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text")
    return ordered.select("conv_id", "layout", "role", "text").mapInArrow(run, "conv_id long, formatted string, loss_start int, loss_end int")


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from ``formatted_turns`` in its order. Only hash
    states are held, so a conversation may be of any length. n_unmapped: records without a layout,
    so that a conversation that has only these still has a row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None

        def row() -> tuple:
            conv, n, turns, chars, loss, total, unmapped = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, unmapped

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_unmapped"])

        for batch in it:
            rows = []
            for conv, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        rows.append(row())
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in read_back(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                masked = unescape(text[start:end])
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(text)
                state[6] += not text
            yield out(rows)
        yield out([row()] if state is not None else [])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_unmapped long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as records of the layout `turn`."""
    return conversations.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
