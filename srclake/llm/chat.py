"""Chat formatting: a finite-state machine over roles and a declarative template with per-segment loss flags.

A template names, for each role, the control strings before and after a text and whether the text is trained on.  The
machine reads the roles in turn order: from a state, a role leads to the next state or the order is invalid (the
conversation is formatted all the same and flagged).  Control strings inside texts are escaped by backslashes,
reversibly: a run of n backslashes before a control string, or at the end of a text, is doubled, and a literal control
string gets one more.  `read_back` undoes it.

Defined results: null texts are empty; a null role is the role "" and, like any role unknown to the template, takes
the template's default entry and makes the order invalid.  Turns are ordered by (turn, role, text), nulls first;
repeated rows are turns of their own.  Rows of a null conv_id form one conversation of null id.  No rows: no
conversations.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """For each role (before, after, loss); `default` stands for other roles, with the role's escaped name at {role}."""

    begin: str = "<s>"
    end: str = "</s>"
    roles: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]", False), "user": ("[INST]", "[/INST]", False), "assistant": ("[ANS]", "[/ANS]", True)})
    default: tuple[str, str, str, bool] = ("[ROLE]", "[TEXT]", "[/TEXT]", False)
    #: state -> role -> next state; an order is valid if every step is and it ends in an accepting state
    states: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    accepting: tuple[str, ...] = ("user", "assistant")

    def controls(self) -> list[str]:
        found = {self.begin, self.end, *self.default[:3], *(s for b, a, _ in self.roles.values() for s in (b, a))}
        return sorted(found, key=lambda s: (-len(s), s))


class Codec:
    def __init__(self, template: Template):
        self.template = template
        either = "|".join(map(re.escape, template.controls()))
        self._write = re.compile(rf"(\\*)({either}|\Z)")
        self._read = re.compile(rf"(\\*)({either})")
        self._ends = re.compile(r"(\\+)\Z")

    def escape(self, text: str) -> str:
        return self._write.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        """(text, loss) pieces of one conversation, in order."""
        t, out = self.template, [(self.template.begin, False)]
        for role, text in turns:
            if role in t.roles:
                before, after, loss = t.roles[role]
                out += [(before, False), (self.escape(text), loss), (after, False)]
            else:
                name, before, after, loss = t.default
                out += [(name + self.escape(role) + before, False), (self.escape(text), loss), (after, False)]
        return [*out, (t.end, False)]

    def valid(self, roles: list[str]) -> bool:
        state = "start"
        for r in roles:
            state = self.template.states.get(state, {}).get(r)
            if state is None:
                return False
        return state in self.template.accepting

    def parts(self, formatted: str) -> list[tuple[bool, str]]:
        """(is a control string, unescaped text) in order."""
        out, held, at = [], [], 0
        for m in self._read.finditer(formatted):
            held.append(formatted[at : m.start()])
            held.append(m[1][: len(m[1]) // 2])
            if len(m[1]) % 2:
                held.append(m[2])
            else:
                out += [(False, "".join(held)), (True, m[2])]
                held = []
            at = m.end()
        return out

    def read_back(self, formatted: str) -> list[tuple[str, str, bool]]:
        """(role, text, loss) of each turn, from the formatted text alone."""
        t = self.template
        by_before = {b: (role, loss) for role, (b, _, loss) in t.roles.items()}
        out, role, opened = [], None, ""
        for control, s in self.parts(formatted):
            if not control:
                opened = s
            elif s in by_before:
                role, loss = by_before[s]
            elif s == t.default[1]:
                role, loss = opened, t.default[3]
            elif role is not None and s != t.default[0] and s not in (t.begin, t.end):
                out.append((role, opened, loss))
                role = None
        return out


FORMATTED = "conv_id long, n_turns long, valid boolean, formatted string, segments array<struct<text:string,loss:boolean>>"


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: its formatted text, the segments with loss flags, and whether the order is valid.

    The turns of one conversation are gathered by a partial aggregate; a conversation is one output text."""
    template = template or Template()
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches):
        codec = Codec(template)
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), 256):
                out = []
                for r in rows[at : at + 256]:
                    turns = [(t["role"], t["text"]) for t in r["turns"]]
                    segs = codec.segments(turns)
                    out.append((r["conv_id"], len(turns), codec.valid([x for x, _ in turns]), "".join(s for s, _ in segs), [{"text": s, "loss": l} for s, l in segs]))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))], names=["conv_id", "n_turns", "valid", "formatted", "segments"])

    return gathered.mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of what is read back from the formatted texts."""
    template = template or Template()

    def run(batches):
        codec = Codec(template)
        for batch in batches:
            out = []
            for conv, valid, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "valid", "formatted")), strict=True):
                turns = codec.read_back(text)
                every = "".join(f"{role}\n{t}\n" for role, t, _ in turns)
                under = "".join(t for _, t, loss in turns if loss)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, len(turns), sha(every), len(under), sha(under), len(text), valid))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

    return formatted.select("conv_id", "valid", "formatted").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one, -1, whose texts hold control strings."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(c.unionByName(extra)))


#: Control strings are 6 characters on average: begin and end 7, user 13, system 11, assistant 11; conversation -1 has
#: three controls in each text, each escaped by one backslash.
OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '(\\*)(</s>|<s>|\[/?(?:SYS|INST|ANS|TEXT)\]|\[ROLE\])', '\1\1\\\2', 'g'), '(\\+)$', '\1\1'))
            + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 11 ELSE 19 + length(role) END AS chars,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) + 7 AS BIGINT) AS formatted_chars,
       bool_and(coalesce(CASE WHEN prev IS NULL THEN role IN ('system', 'user')
                              WHEN prev IN ('system', 'assistant') THEN role = 'user'
                              WHEN prev = 'user' THEN role = 'assistant' ELSE false END, false)
                AND (back > 1 OR role IN ('user', 'assistant'))) AS valid
FROM t GROUP BY conv_id
"""
