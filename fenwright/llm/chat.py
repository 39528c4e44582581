"""Operator 7: chat formatting by schema fingerprints.

A record is JSON of any layout. Its nested field paths (array elements as `[]`, values ignored, names sorted) are hashed;
the hash selects a declarative mapping from a registry, and the mapping turns the record into canonical turns (role, text).
A mapping is data: either a list of (role, path), or a path to a list of messages with the names of the role and text
fields and, where needed, how role names translate. Records whose fingerprint is not registered are returned with an error.

Turns are then written with a template. Inside texts every control string of the template, and those of other common
templates, is broken by a backslash behind its first character, and backslashes are doubled: no control string is left in
a text, and the text can be read back. The loss mask is the list of spans of assistant texts.

Defined cases: rows of a conversation are ordered by turn, then role and text (nulls first); repeated rows are turns of their
own; a null text or role is empty; a null conv_id is a conversation; a record that is not JSON has no fingerprint and the error
"not JSON", one nested deeper than Python's parser goes "nested too deep", and one with half of a surrogate pair in a name or a text
"not Unicode", as it cannot be written in UTF-8; an empty list of messages has no turns, and an entry that is no object is a
turn without role and text; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Control strings of chat templates (fixed values); those of our template come first.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|user|>", "<|assistant|>", "<|system|>"]
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class Mapping:
    """fields: pairs (role, path) in the order of turns, an absent or empty one that is `optional` is left out. Or messages:
    the path of a list, with role and text the names of its fields."""

    fields: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = frozenset()
    messages: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = field(default=())


def paths(value: object, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}") for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(value: object) -> str:
    return hashlib.sha256("\n".join(sorted(paths(value))).encode()).hexdigest()[:16]


_PEOPLE = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: An example of each layout, and its mapping.
LAYOUTS: list[tuple[object, Mapping]] = [
    ({"messages": [{"role": "", "content": ""}]}, Mapping(messages="messages", role="role", text="content")),
    ({"messages": []}, Mapping(messages="messages", role="role", text="content")),
    ({"conversations": [{"from": "", "value": ""}]}, Mapping(messages="conversations", role="from", text="value", roles=_PEOPLE)),
    ({"prompt": "", "response": ""}, Mapping(fields=(("user", "prompt"), ("assistant", "response")))),
    ({"prompt": "", "completion": ""}, Mapping(fields=(("user", "prompt"), ("assistant", "completion")))),
    ({"system": "", "prompt": "", "response": ""}, Mapping(fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")))),
    ({"instruction": "", "output": ""}, Mapping(fields=(("user", "instruction"), ("assistant", "output")))),
    ({"instruction": "", "input": "", "output": ""}, Mapping(fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=frozenset({"input"}))),
    ({"data": {"question": "", "answer": ""}}, Mapping(fields=(("user", "data.question"), ("assistant", "data.answer")))),
]


def registry(layouts: list[tuple[object, Mapping]] = LAYOUTS) -> dict[str, Mapping]:
    return {fingerprint(example): mapping for example, mapping in layouts}


def _at(value: object, path: str) -> object:
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _string(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def turns(record: object, mapping: Mapping) -> list[tuple[str, str]]:
    if not mapping.messages:
        got = [(role, path, _string(_at(record, path))) for role, path in mapping.fields]
        return [(role, text) for role, path, text in got if text or path not in mapping.optional]
    names = dict(mapping.roles)
    return [(names.get(r := _string(_at(m, mapping.role)), r), _string(_at(m, mapping.text))) for m in _at(record, mapping.messages) or ()]


def write(conversation: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in conversation:
        head, body = f"<|im_start|>{quote(role, safe=' ')}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + "<|im_end|>\n")
        at += len(out[-1])
    return "".join(out), spans


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read(formatted: str) -> list[tuple[str, str]]:
    return [(unquote(role), unescape(text)) for role, text in _TURN.findall(formatted)]


SCHEMA = "id long, fingerprint string, formatted string, loss_spans array<struct<begin: int, end: int>>, error string"


def format_records(records: DataFrame, layouts: list[tuple[object, Mapping]] = LAYOUTS) -> DataFrame:
    """records: (id, record), the record a JSON text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(layouts)
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for raw in b.column(1):
                mark = text = spans = error = None
                try:
                    record = json.loads(raw.as_py() or "")
                    mark = fingerprint(record)
                    if mark in known:
                        text, at = write(turns(record, known[mark]))
                        text.encode()
                        spans = [{"begin": a, "end": e} for a, e in at]
                    else:
                        error = "unknown layout"
                except UnicodeEncodeError:
                    mark, text, error = None, None, "not Unicode"
                except ValueError:
                    error = "not JSON"
                except RecursionError:
                    error = "nested too deep"
                for col, x in zip(cols, (mark, text, spans, error), strict=True):
                    col.append(x)
            kinds = (pa.string(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "fingerprint", "formatted", "loss_spans", "error"])

    return records.select(F.col("id").cast("long"), F.col("record").cast("string")).mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Facts of formatted records, from their text and spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist(), strict=True):
                got = read(text or "")
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans or ())
                row = (len(got), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in got).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text or ""))
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["conv_id", *names])

    return formatted.select("id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """One JSON record per conversation, in the plainest layout that holds it: prompt and response, the same with a system
    text, or a list of messages."""
    c = conversations.select(F.col("conv_id").cast("long").alias("id"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    c = c.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    text = lambda i: F.get("m", F.lit(i))["content"]
    shape = F.array_join(F.transform("m", lambda m: m["role"]), "\n")
    messages = F.to_json(F.struct(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")))
    record = (
        F.when((F.size("m") == 2) & (shape == "user\nassistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when((F.size("m") == 3) & (shape == "system\nuser\nassistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .otherwise(messages)
    )
    return c.select("id", record.alias("record"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_records(conversation_records(rows)))


_SQL_CONTROL = "|".join(re.escape(c) for c in CONTROL).replace("'", "''")
OP7_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + 2 * length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '{_SQL_CONTROL}')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
