"""Chat formatting: records of unlike layouts become turns by the fingerprint of their schema.

A record is a JSON text. Its fingerprint is a hash of the set of its nested field paths (``messages[].role``), so all
records of one layout share it whatever they say. A fingerprint selects a mapping, which only declares where roles
and texts stand; a layout that no mapping knows comes back as it is, with its fingerprint and paths, and is not dropped.

The template puts ``<|im_start|>role`` and a line break before a text and ``<|im_end|>`` and a line break after it. Inside texts and roles a
backslash goes between ``<`` and ``|``, one more where there are some, so no text can hold a control string, and taking one away
gives the text back. The loss mask are the spans, in code points, of the assistant's texts.

A long conversation is a row of records of at most ``PART`` turns; it is never held as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.llm.work import take

PART = 64
START, END = "<|im_start|>", "<|im_end|>"

# where turns stand: fixed fields with a role each, or a list with a field for role and text
MAPPINGS = [
    {"fields": [("user", "prompt"), ("assistant", "completion")]},
    {"fields": [("user", "prompt"), ("assistant", "response")]},
    {"fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"fields": [("user", "instruction"), ("assistant", "output")]},
    {"fields": [("system", "system"), ("user", "instruction"), ("assistant", "output")]},
    {"fields": [("user", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"fields": [("user", "question"), ("assistant", "answer")]},
    {"list": "messages", "role": "role", "text": "content"},
    {"list": "data.messages", "role": "author.role", "text": "content.text"},
    {"list": "conversations", "role": "from", "text": "value", "names": {"human": "user", "gpt": "assistant"}},
]


# --- fingerprints ------------------------------------------------------------------------------------------


def paths(value, at: str = "") -> set[str]:
    """Paths of all fields that are no objects; a list adds ``[]``."""
    if isinstance(value, dict):
        found = set()
        for name, inner in value.items():
            found |= paths(inner, f"{at}.{name}" if at else name)
        return found
    if isinstance(value, list):
        found = set()
        for inner in value:
            found |= paths(inner, at + "[]")
        return found or {at + "[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def declared(mapping: dict) -> set[str]:
    """The paths of records that a mapping is for."""
    if "fields" in mapping:
        return {path for _, path in mapping["fields"]}
    return {f"{mapping['list']}[].{mapping['role']}", f"{mapping['list']}[].{mapping['text']}"}


def registry(mappings: list[dict]) -> dict[str, dict]:
    return {fingerprint(declared(m)): m for m in mappings}


def _inside(value, path: str):
    for name in path.split("."):
        value = value[name]
    return value


def turns_of(record, mapping: dict) -> list[tuple[str, str]]:
    if "fields" in mapping:
        return [(role, _text(_inside(record, path))) for role, path in mapping["fields"]]
    names = mapping.get("names", {})
    out = []
    for item in _inside(record, mapping["list"]):
        role = _text(_inside(item, mapping["role"]))
        out.append((names.get(role, role), _text(_inside(item, mapping["text"]))))
    return out


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


# --- template ----------------------------------------------------------------------------------------------


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role_out(role: str) -> str:
    return escaped(role).replace("%", "%25").replace("\n", "%0A")


def _role_in(role: str) -> str:
    return unescaped(role.replace("%0A", "\n").replace("%25", "%"))


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns and the spans of the assistant's texts in it."""
    out, at, spans = [], 0, []
    for role, text in turns:
        before, inside = f"{START}{_role_out(role)}\n", escaped(text)
        out += [before, inside, END, "\n"]
        begin = at + len(before)
        if role == "assistant":
            spans.append((begin, begin + len(inside)))
        at = begin + len(inside) + len(END) + 1
    return "".join(out), spans


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns that a formatted text was made from."""
    out, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line + 1)
        out.append((_role_in(text[at + len(START) : line]), unescaped(text[line + 1 : end])))
        at = end + len(END) + 1
    return out


# --- over tables -------------------------------------------------------------------------------------------


def format_records(records: DataFrame, mappings: list[dict] = MAPPINGS) -> DataFrame:
    """``key, part, fingerprint, formatted, spans, unmapped`` for each row of ``records`` (key, part, record); others are ignored.

    ``spans`` are the assistant's texts in ``formatted``, in code points. A record that is null, no JSON object or of a layout
    that no mapping knows has null in ``formatted`` and stands in ``unmapped``. Null fields of a known layout are empty
    texts. Repeated rows come back repeated; keys are not used. An empty table gives an empty result.
    """
    known = registry(mappings)
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    names = ["key", "part", "fingerprint", "formatted", "spans", "unmapped"]

    def run(batches):
        for batch in batches:
            rows = []
            for record in batch.column("record"):
                source = record.as_py()
                try:
                    value = json.loads(source) if source is not None else None
                except ValueError:
                    value = None
                mark = fingerprint(paths(value)) if isinstance(value, dict) else None
                mapping = known.get(mark)
                if mapping is None:
                    rows.append((mark, None, None, source if source is not None else ""))
                else:
                    text, spans = formatted(turns_of(value, mapping))
                    rows.append((mark, text, [{"begin": b, "end": e} for b, e in spans], None))
            columns = zip(*rows) if rows else [()] * 4
            types = (pa.string(), pa.string(), spans_type, pa.string())
            yield pa.record_batch(
                [batch.column("key"), batch.column("part"), *[pa.array(c, t) for c, t in zip(columns, types)]], names
            )

    wanted = take(records, key="long", part="long", record="string")
    return wanted.mapInArrow(
        run, "key long, part long, fingerprint string, formatted string, spans array<struct<begin:long,end:long>>, unmapped string"
    )


def records_of(conversations: DataFrame) -> DataFrame:
    """``key, part, record``: conversations (conv_id, turn, role, text) as records of several layouts.

    Turns come in the order of ``turn``; nulls come first, ties by role and text. A null role or text is empty. A
    part of two or three turns with the usual roles becomes a prompt or instruction record, any other a list of messages.
    """
    rows = take(conversations, conv_id="long", turn="long", role="string", text="string")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select(F.col("conv_id").alias("key"), "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("turn", "role", "text")) - 1
    rows = rows.withColumn("place", place).withColumn("part", F.floor(F.col("place") / PART))
    parts = rows.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    roles = F.array_join(F.transform("turns", lambda t: t["role"]), "\u0001")

    def said(i):
        return F.element_at("turns", i)["text"]

    even = F.pmod(F.coalesce("key", F.lit(0)), F.lit(2)) == 0
    record = (
        F.when((roles == "user\u0001assistant") & even, F.to_json(F.struct(said(1).alias("prompt"), said(2).alias("completion"))))
        .when(roles == "user\u0001assistant", F.to_json(F.struct(said(1).alias("instruction"), said(2).alias("output"))))
        .when(
            roles == "system\u0001user\u0001assistant",
            F.to_json(F.struct(said(1).alias("system"), said(2).alias("instruction"), said(3).alias("output"))),
        )
        .when(even, F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))))
        .otherwise(
            F.to_json(
                F.struct(
                    F.struct(
                        F.transform(
                            "turns", lambda t: F.struct(F.struct(t["role"].alias("role")).alias("author"), F.struct(t["text"].alias("text")).alias("content"))
                        ).alias("messages")
                    ).alias("data")
                )
            )
        )
    )
    return parts.select("key", "part", record.alias("record"))


def digests(done: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted parts: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Parts come sorted and are read one after the other, so a conversation of any length is hashed without being held.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, rows = None, []

        def close():
            rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def flush():
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows.clear()
            return out

        for batch in batches:
            for key, text, spans in zip(batch.column("key").to_pylist(), batch.column("formatted"), batch.column("spans")):
                text = text.as_py()
                if now is None or now[0] != key:
                    if now is not None:
                        close()
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in spans.as_py():
                    learnt = unescaped(text[span["begin"] : span["end"]])
                    now[3] += len(learnt)
                    now[4].update(learnt.encode())
                now[5] += len(text)
            if len(rows) >= 10_000:
                yield flush()
        if now is not None:
            close()
        if rows:
            yield flush()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    ordered = done.where("formatted IS NOT NULL").repartition("key").sortWithinPartitions("key", "part")
    return ordered.select("key", "formatted", "spans").mapInArrow(run, schema)
