"""Chat formatting: layouts are told apart by a fingerprint of their field paths.

A record's fingerprint is the hash of its sorted nested field paths
(``messages[].role`` and so on). It selects a declarative mapping from a
registry, which turns prompt, instruction and message layouts into canonical
turns. New layouts are registered by an example; none is guessed.

The template marks each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside
roles and texts a control string gets one backslash more after its first
character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), so no
control string of any listed template survives and taking one backslash away
gives the text back.

Defined results: a null text or role is empty; turns are ordered by number,
then role and text, so ties and repeated rows have a fixed order; rows of a null
conversation id form one conversation; a record of an unknown layout or broken
JSON has an error and no turns; an empty table gives no rows. A table of turns
with further columns has another fingerprint, so :func:`format_turns` takes it for an
unknown layout and raises an error; callers select its four columns first. A
conversation's turns are formatted row by row and read back in a
stream, so a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import read, ship

START, END = "<|im_start|>", "<|im_end|>\n"
#: First characters and rests of control strings (fixed values).
CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of a JSON value's fields; elements of an array share one path."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(paths: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def schema_paths(schema: T.StructType) -> set[str]:
    """The field paths of a table's rows, from its schema alone."""

    def walk(kind: T.DataType, at: str) -> set[str]:
        if isinstance(kind, T.StructType):
            return set().union(*(walk(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind)) if kind.fields else {at + "{}"}
        return walk(kind.elementType, at + "[]") if isinstance(kind, T.ArrayType) else {at}

    return walk(schema, "")


#: Layouts: example paths, and the mapping they select. A mapping has fixed turns (role, path) or a list with keys for role and text.
LAYOUTS: list[tuple[list[str], dict]] = [
    (["prompt", "response"], {"turns": [("user", "prompt"), ("assistant", "response")]}),
    (["prompt", "completion"], {"turns": [("user", "prompt"), ("assistant", "completion")]}),
    (["system", "prompt", "response"], {"turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]}),
    (["question", "answer"], {"turns": [("user", "question"), ("assistant", "answer")]}),
    (["instruction", "output"], {"turns": [("user", "instruction"), ("assistant", "output")]}),
    (["instruction", "input", "output"], {"turns": [("user", ("instruction", "input")), ("assistant", "output")]}),
    (["messages[].role", "messages[].content"], {"list": "messages", "role": "role", "text": "content"}),
    (["conversations[].from", "conversations[].value"], {"list": "conversations", "role": "from", "text": "value"}),
    (["system", "conversations[].from", "conversations[].value"], {"system": "system", "list": "conversations", "role": "from", "text": "value"}),
    (["data.turns[].speaker", "data.turns[].utterance"], {"list": "data.turns", "role": "speaker", "text": "utterance"}),
    (["conv_id", "turn", "role", "text"], {"rows": {"conversation": "conv_id", "order": "turn", "role": "role", "text": "text"}}),
]
#: Canonical names of roles (fixed values); other roles stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
REGISTRY = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}


def _dig(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: dict, mapping: dict) -> list[tuple[str, str]]:
    out = []
    if "system" in mapping:
        out.append(("system", _text(_dig(record, mapping["system"]))))
    for role, path in mapping.get("turns", []):
        parts = [_text(_dig(record, p)) for p in ((path,) if isinstance(path, str) else path)]
        out.append((role, "\n\n".join(p for p in parts if p)))
    if "list" in mapping:
        for item in _dig(record, mapping["list"]) or []:
            role = _text(_dig(item, mapping["role"]))
            out.append((ROLES.get(role.lower(), role), _text(_dig(item, mapping["text"]))))
    return out


def convert(records: DataFrame, json_col: str = "record", registry: dict[str, dict] | None = None) -> DataFrame:
    """``records`` with fingerprint, turns and error for the JSON text of each row."""
    ship(records.sparkSession)
    known = REGISTRY if registry is None else registry

    @F.pandas_udf(f"fingerprint string, turns {TURNS}, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                record = json.loads(text)
                mark = fingerprint(field_paths(record))
            except (TypeError, ValueError):
                rows.append((None, None, "not JSON"))
                continue
            mapping = known.get(mark)
            if mapping is None or "rows" in mapping:
                rows.append((mark, None, "unknown layout"))
            else:
                rows.append((mark, [{"role": r, "text": t} for r, t in canonical_turns(record, mapping)], None))
        return pd.DataFrame(rows, columns=["fingerprint", "turns", "error"])

    return records.withColumn("__chat", run(F.col(json_col).cast("string"))).select(*[F.col(f"`{c}`") for c in records.columns if c not in ("fingerprint", "turns", "error")], "__chat.*")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: str) -> str:
    return re.sub(CONTROL, lambda m: m[1] + m[2][1:] + m[3], text)


def segment(role: Column, text: Column) -> Column:
    """One formatted turn. A role is kept on its line: backslashes are doubled and line ends written as \\n."""
    role = F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(START), escape(role), F.lit("\n"), escape(F.coalesce(text, F.lit(""))), F.lit(END))


def format_turns(df: DataFrame) -> DataFrame:
    """conv_id, turn, segment of a table with one row per turn, whose layout is told by its schema."""
    mark = fingerprint(schema_paths(df.schema))
    mapping = REGISTRY.get(mark, {}).get("rows")
    if mapping is None:
        raise ValueError(f"no mapping of rows to turns for layout {mark}")
    role, text = F.col(mapping["role"]).cast("string"), F.col(mapping["text"]).cast("string")
    return df.select(F.col(mapping["conversation"]).cast("long").alias("conv_id"), F.col(mapping["order"]).cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn(
        "segment", segment(F.col("role"), F.col("text"))
    )


def format_conversations(df: DataFrame) -> DataFrame:
    """conv_id and the whole formatted text, for conversations that fit into a row."""
    rows = format_turns(df).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "segment"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a formatted text."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))
        out.append((role, unescape(text[: -len(END)])))
    return out


def read_back(turns: DataFrame) -> DataFrame:
    """The digests of each conversation, from its formatted segments in order.

    Rows are dealt by conversation and sorted, and hashed as they stream by.
    """
    ship(turns.sparkSession)
    dealt = turns.select("conv_id", "turn", "role", "text", "segment").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "segment")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def row() -> tuple:
            n, sha, chars, loss, total = state
            return (None if current == "null" else int(current), n, sha.hexdigest(), chars, loss.hexdigest(), total)

        for batch in batches:
            done = []
            for conv, piece in zip(batch["conv_id"], batch["segment"], strict=True):
                conv = "null" if pd.isna(conv) else conv
                if state is None or conv != current:
                    if state is not None:
                        done.append(row())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(piece)
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "surrogatepass"))
            if done:
                yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
        if state is not None:
            yield pd.DataFrame([row()], columns=names).astype({"conv_id": "Int64"})

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return dealt.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(own).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    return read_back(format_turns(df.unionByName(extra)))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, len(regexp_extract_all(text, '[<\[]\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)')) AS marks FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + marks + 24)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
