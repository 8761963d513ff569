"""Chat formatting: records of many layouts become canonical turns, and turns one reversible template.

The layout of a record is known by its fingerprint, a hash of its nested field paths. A fingerprint selects
a declarative mapping: where the turns are, which fields hold role and text, or which fixed fields make which
turns. Turns of a conversation are written in order as

    ### role: text</turn>\\n

Within roles and texts every backslash, ``###`` and ``</turn>`` gets a backslash before it (in roles the colon
too), so the template's own marks can be told from those in texts. The loss mask covers assistant texts.
Conversations are streamed in order through a task and given out in parts of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_CHARS = 1 << 20


class Mapping(NamedTuple):
    """``fields``: fixed turns as (role, path); ``turns``: path of a list, with its role and text fields."""

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    turns: str | None = None
    role: str = ""
    text: str = ""


#: names of speakers that other layouts use
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

MAPPINGS = (
    Mapping("turn", ("role", "text"), turns="", role="role", text="text"),
    Mapping("turn_content", ("role", "content"), turns="", role="role", text="content"),
    Mapping("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("question", "answer"), (("user", "question"), ("assistant", "answer"))),
    Mapping("system_question_response", ("system_prompt", "question", "response"), (("system", "system_prompt"), ("user", "question"), ("assistant", "response"))),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("messages", ("messages[].content", "messages[].role"), turns="messages", role="role", text="content"),
    Mapping("dialog", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Mapping("dialog_system", ("conversations[].from", "conversations[].value", "system"), (("system", "system"),), "conversations", "from", "value"),
)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves; a list adds ``[]`` and the union over its items."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(m.paths): m for m in MAPPINGS}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, registry: dict[str, Mapping]) -> tuple[str, list[tuple[str, str]]]:
    """(layout, canonical turns). Records of no known layout have none; empty system and input fields are left out."""
    mapping = registry.get(fingerprint(field_paths(record)))
    if mapping is None:
        return "unknown", []
    out = [(role, _text(record[path])) for role, path in mapping.fields]
    out = [(r, t) for (r, t), (_, path) in zip(out, mapping.fields) if t or path not in ("input", "system", "system_prompt")]
    if mapping.turns is not None:
        for x in record[mapping.turns] if mapping.turns else [record]:
            role = _text(x.get(mapping.role))
            out.append((ROLE_NAMES.get(role, role), _text(x.get(mapping.text))))
    return mapping.name, out


def canonical(records: DataFrame, id_col: str, seq_col: str, json_col: str, registry: dict[str, Mapping] = REGISTRY) -> DataFrame:
    """(id, seq, k, role, text, layout): the turns of each JSON record. Text that is no JSON object, and null, has
    layout ``unknown`` and gives one row without role and text, so that nothing is lost unseen."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, s, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    record = json.loads(body) if body else None
                except ValueError:
                    record = None
                layout, turns = turns_of(record, registry) if isinstance(record, dict) else ("unknown", [])
                out += [(i, s, k, r, t, layout) for k, (r, t) in enumerate(turns)] or [(i, s, 0, None, None, layout)]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "seq", "k", "role", "text", "layout"])

    return records.select(F.col(id_col).cast("long"), F.col(seq_col).cast("long"), F.col(json_col)).mapInArrow(rows, "id long, seq long, k int, role string, text string, layout string")


MARKS = re.compile(r"\\|###|</turn>")
ROLE_MARKS = re.compile(r"\\|###|</turn>|:")
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str, marks: re.Pattern = MARKS) -> str:
    return marks.sub(lambda m: "\\" + m.group(0), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_chats(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(id, part, formatted, starts, ends): conversations in parts of about ``part_chars`` characters.

    ``starts`` and ``ends`` are the spans under the loss mask, in code points of the part. Turns are ordered by
    seq, their place in the record, role and text; rows of layout ``unknown`` are left out. A null role or
    text counts as empty, and all rows without id are one conversation. One that is longer than memory passes
    through its task in parts.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, text, size, spans, out = None, 0, [], 0, [], []

        def close():
            out.append((at[0], part, "".join(text), [a for a, _ in spans], [z for _, z in spans]))

        def batch():
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "part", "formatted", "starts", "ends"])

        held = 0
        for b in batches:
            for i, role, body in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if at is not None and (i != at[0] or size >= part_chars):
                    close()
                    held += size
                    part = part + 1 if i == at[0] else 0
                    text, size, spans = [], 0, []
                at = (i,)
                head, own = f"### {escape(role or '', ROLE_MARKS)}: ", escape(body or "")
                if role == "assistant":
                    spans.append((size + len(head), size + len(head) + len(own)))
                text += [head, own, "</turn>\n"]
                size += len(head) + len(own) + 8
                if held > 4 * PART_CHARS:
                    yield batch()
                    out, held = [], 0
        if at is not None:
            close()
        if out:
            yield batch()

    order = ["id", "seq", "k", "role", "text"]
    known = turns.where("layout <> 'unknown'").select(*order)
    return known.repartition("id").sortWithinPartitions(*order).mapInArrow(rows, "id long, part int, formatted string, starts array<long>, ends array<long>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the formatted parts alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []

        def close():
            i, n, turns, chars, loss, size = at
            out.append((i, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for i, body, starts, ends in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if at is None or i != at[0]:
                    if at is not None:
                        close()
                    at = [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                place = 0
                for m in TURN.finditer(body):
                    if m.start() != place:
                        raise ValueError("formatted text that is no turn")
                    place = m.end()
                    at[1] += 1
                    at[2].update(f"{unescape(m.group(1))}\n{unescape(m.group(2))}\n".encode())
                if place != len(body):
                    raise ValueError("formatted text that is no turn")
                for a, z in zip(starts, ends):
                    plain = unescape(body[a:z])
                    at[3] += len(plain)
                    at[4].update(plain.encode())
                at[5] += len(body)
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if at is not None:
            close()
        if out:
            yield batch(out)

    def batch(out):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    parts = formatted.repartition("id").sortWithinPartitions("id", "part")
    return parts.mapInArrow(rows, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
