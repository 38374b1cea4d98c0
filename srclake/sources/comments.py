"""Documentation comments from text, the declaration that each belongs to, and their text as Markdown (SRC12).

Documentation comments are /** */ and /*! */ blocks and runs of /// or //! lines.  One belongs to the next node of its
file that is a definition or declaration, if neither ; { } # nor @ stands between; one marked with < to the last node
before it, if that is on the comment's first line.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from .preprocessor import _TOKEN, ROWS

COMMENTS = "file_id long, n int, text string, trailing boolean, line int, col int, end_line int, end_col int, until_line int, until_col int"
_WORD = re.compile(r"[\\@](\w+)")
#: Commands whose next word is set in a style of its own.
STYLES = {"b": "**", "c": "`", "p": "`", "a": "*", "e": "*", "em": "*"}
#: Commands with a text up to their end command, line by line.
VERBATIM = {"code": "endcode", "verbatim": "endverbatim"}
BRIEF, RETURN, PARAM, TPARAM = ("brief", "short"), ("return", "returns", "result"), ("param",), ("tparam",)


def comments(text: str):
    """(text, trailing, start, end, until) of the documentation comments; until: the place of the next ; { } # or @."""
    run: list | None = None
    found, broke = [], []
    for t in _TOKEN.finditer(text):
        s = t.group()
        block = s.startswith(("/**", "/*!")) and not s.startswith(("/***", "/**/"))
        line = s.startswith(("///", "//!")) and not s.startswith("////")
        if line and run is not None and (s[3:4] == "<") == (run[0][3:4] == "<"):
            run[0] += "\n" + s
            run[2] = t.end()
            continue
        if s.isspace() and s.count("\n") <= 1:
            continue
        run = None
        if block or line:
            found.append([s, t.start(), t.end()])
            run = found[-1] if line else None
        elif s in tuple(";{}#@"):
            broke.append(t.start())
    for s, a, b in found:
        i = bisect.bisect_left(broke, b)
        yield s, bool(re.match(r"(/\*[*!]|//[/!])<", s)), a, b, broke[i] if i < len(broke) else len(text)


def bare(comment: str) -> list[str]:
    """The lines of a comment without its marks."""
    if comment.startswith("/*"):
        body = re.sub(r"\*+/\Z", "", re.sub(r"\A/\*[*!]<?", "", comment))
        return [re.sub(r"\A[ \t]*\*", "", x) if i else x for i, x in enumerate(body.split("\n"))]
    return [re.sub(r"\A[ \t]*//[/!]<?", "", x) for x in comment.split("\n")]


def _styled(text: str) -> str:
    """Inline commands and the word that follows each."""
    return re.sub(r"[\\@](em|[bcpae])[ \t]+(\S+)", lambda m: STYLES[m[1]] + m[2] + STYLES[m[1]], text)


def markdown(comment: str) -> str:
    """The brief (or else first) paragraph, the other blocks, then template parameters, parameters and what is
    returned.  A block ends at an empty line or at the next command."""
    blocks: list[list] = []  # command, text so far (a line after the other, each with a space)
    until, now = None, None
    for line in bare(comment):
        if until:
            if re.search(rf"[\\@]{until}\b", line):
                until = now = None
            else:
                now[1].append(line.rstrip())
            continue
        if not line.strip():
            now = None
            continue
        at = 0
        while at < len(line):
            m = next((m for m in _WORD.finditer(line, at) if m[1] not in STYLES and (m.start() == 0 or line[m.start() - 1].isspace())), None)
            text = line[at : m.start() if m else len(line)].strip()
            if text:
                if now is None:
                    blocks.append(now := ["", []])
                now[1].append(_styled(text))
            if not m:
                break
            at = m.end()
            blocks.append(now := [m[1], []])
            if m[1] in VERBATIM:
                until = VERBATIM[m[1]]
                if re.search(rf"[\\@]{until}\b", line[at:]):
                    now[1].append(line[at : re.search(rf"[\\@]{until}\b", line[at:]).start() + at].strip())
                    until = now = None
                break
            if m[1] in PARAM and (d := re.match(r"\s*\[([\w, ]+)\]", line[at:])):
                now[0] = f"param {','.join(w for w in ('in', 'out') if w in d[1])}"
                at += d.end()

    text = lambda lines: "".join(x + " " for x in lines)

    def named(b):
        whole = text(b[1]).split(None, 1)
        return (whole[0], whole[1] if len(whole) > 1 else "") if whole else ("", "")

    of = lambda names: [b for b in blocks if b[0].split(" ")[0] in names]
    brief = next(iter(of(BRIEF)), None)
    first = None if brief else next((b for b in blocks if not b[0]), None)
    out = [text(brief[1])] if brief else [text(first[1]) + "\n\n"] if first else []
    for b in blocks:
        if b is first or b[0].split(" ")[0] in (*BRIEF, *RETURN, *PARAM, *TPARAM):
            continue
        out.append(("```\n" + "\n".join(b[1]) + "\n```" if b[0] in VERBATIM else text(b[1])) + "\n\n")
    if tparams := of(TPARAM):
        out += ["\n**Template parameters:**\n", *("- **{}**: {}\n".format(*named(b)) for b in tparams)]
    if params := of(PARAM):
        out += ["\n**Parameters:**\n", *("- *{}*: **{}** {}\n".format((b[0].split(" ") + ["in"])[1] or "in", *named(b)) for b in params)]
    if returns := of(RETURN):
        out += ["\n**Return:**\n", *(text(b[1]) for b in returns)]
    return "".join(out)


def extracted(files: DataFrame) -> DataFrame:
    """COMMENTS of files (file_id, content), their text as Markdown."""

    def run(batches):
        out, columns = [], [c.split()[0] for c in COMMENTS.split(", ")]
        for pdf in batches:
            for fid, content in zip(pdf["file_id"], pdf["content"], strict=True):
                starts = [0, *(m.end() for m in re.finditer("\n", content))]
                place = lambda o, s=starts: (line := bisect.bisect_right(s, o), o - s[line - 1] + 1)
                for n, (text, trailing, a, b, until) in enumerate(comments(content)):
                    out.append((fid, n, markdown(text), trailing, *place(a), *place(b), *place(until)))
                    if len(out) >= ROWS:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return files.where("file_id IS NOT NULL AND content IS NOT NULL").select("file_id", "content").mapInPandas(run, COMMENTS)


def documented(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_comment rows (content_hash, content, entity_hash) of comments and the nodes (ast_node) that they belong to.

    A forward as-of join: comments' ends and nodes' beginnings of a file in one order, each comment with the first
    beginning from its end on; a trailing one with the last before it."""
    named = nodes.where("ast_type IN ('Definition', 'Declaration')").select("file_id", F.struct(F.col("start_line").alias("line"), F.col("start_col").alias("col")).alias("at"), "entity_hash")
    begins = named.select("file_id", "at", F.lit(1).alias("kind"), F.col("at").alias("begin"), F.lit(None).cast("int").alias("n")).distinct()
    ends = found.select("file_id", F.when(F.col("trailing"), F.struct("line", "col")).otherwise(F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("col"))).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(begins.schema["begin"].dataType).alias("begin"), "n")
    # both look back: a frame up to the partition's end is read again for each row
    before = Window.partitionBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    near = begins.unionByName(ends)
    near = near.withColumn("prior", F.last("begin", ignorenulls=True).over(before.orderBy("at", "kind"))).withColumn("next", F.last("begin", ignorenulls=True).over(before.orderBy(F.desc("at"), F.desc("kind"))))
    c = found.join(near.where("kind = 0").select("file_id", "n", "next", "prior"), ["file_id", "n"])
    until = F.struct(F.col("until_line").alias("line"), F.col("until_col").alias("col"))
    at = F.when(F.col("trailing"), F.when(F.col("prior.line") == F.col("line"), F.col("prior"))).when(F.col("next") <= until, F.col("next"))
    own = c.withColumn("at", at).where("at IS NOT NULL").join(named, ["file_id", "at"])
    return own.select(expr.fnv1a("text").alias("content_hash"), F.col("text").alias("content"), "entity_hash").distinct()
