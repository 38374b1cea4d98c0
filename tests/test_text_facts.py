"""Documentation comments and compilers' messages from text."""

import random
import re

import pytest

from srclake.operators.nav import Navigation
from srclake.sources import comments as cm
from srclake.sources import diagnostics as dg
from srclake.store import SCHEMAS

TEXT = """/** Not this one. */
int before;

/**
 * @brief Adds \\b two numbers,
 *   and says so.
 *
 * More about it, see @c add.
 *
 * @tparam T their type
 * @param[in,out] a the first
 * @param b the
 *   second
 * @code
 * add(1, 2);
 *   @odd
 * @endcode
 * \\returns the sum \\note unchecked
 */
// a plain comment
T add(T a, T b);
int field; ///< trails the field
/// first line
/// second line
struct S { /* plain */ int x; };
/** lost */ ;
int last;
char *s = "/** none */";
"""
NODES = [(1, 10, 2, 1), (1, 11, 21, 1), (1, 12, 22, 1), (1, 13, 25, 1), (1, 14, 27, 1)]


def nodes(spark, rows):
    return spark.createDataFrame([(100 + e, e, "", "Function", "Declaration", True, f, line, col, line, col + 1) for f, e, line, col in rows], SCHEMAS["ast_node"])


def test_markdown():
    text = next(c[0] for c in cm.comments(TEXT) if "Adds" in c[0])
    assert cm.markdown(text) == (
        "Adds **two** numbers, and says so. More about it, see `add.` \n\n```\n add(1, 2);\n   @odd\n```\n\nunchecked \n\n"
        "\n**Template parameters:**\n- **T**: their type \n\n**Parameters:**\n- *in,out*: **a** the first \n- *in*: **b** the second \n\n**Return:**\nthe sum "
    )
    assert cm.markdown("/** One\n * two.\n *\n * Three. */") == "One two. \n\nThree. \n\n"
    assert cm.markdown("/// @verbatim x @endverbatim") == "```\nx\n```\n\n" and cm.markdown("/***/") == "" and cm.markdown("/** */") == ""


def test_comments_meet_their_nodes(spark):
    files = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "/** alone */")], "file_id long, content string")
    found = cm.extracted(files)
    assert found.count() == 6
    docs = cm.documented(found, nodes(spark, NODES))
    got = {r["entity_hash"]: r["content"] for r in docs.collect()}
    assert set(got) == {10, 11, 12, 13} and got[10].startswith("Not this one") and got[12] == "trails the field \n\n" and got[13] == "first line second line \n\n"
    f = {k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()} | {"ast_node": nodes(spark, NODES), "doc_comment": docs}
    ids = spark.createDataFrame([(113,)], "id long")
    assert [r["documentation"].strip() for r in Navigation(f).documentation(ids).collect()] == ["first line second line"]


def test_comments_against_brute_force(spark):
    rng = random.Random(3)
    rows, files = [], []
    for f in range(20):
        parts = [rng.choice(["/** d{} */", "/// d{}", "int x{}", ";", "{{", "// c", "#define Q", '"/** s */"', ""]).format(i) for i in range(40)]
        text = "\n".join(parts)
        files.append((f, text))
        rows += [(f, 1000 * f + i, i + 1, 1) for i, p in enumerate(parts) if p.startswith("int x")]
    got = {(r["entity_hash"], r["content"].strip()) for r in cm.documented(cm.extracted(spark.createDataFrame(files, "file_id long, content string")), nodes(spark, rows)).collect()}
    want = set()
    for f, text in files:
        lines, i = text.split("\n"), 0
        while i < len(lines):
            if lines[i].startswith(("/** d", "/// d")):
                j, doc = i + 1, [re.search(r"d\d+", lines[i])[0]]
                while lines[i].startswith("///") and j < len(lines) and lines[j].startswith("///"):
                    doc.append(lines[j][4:])
                    j += 1
                k = j
                while k < len(lines) and not re.match(r"int x|;|\{|#", lines[k]):
                    k += 1
                if k < len(lines) and lines[k].startswith("int x"):
                    want.add((1000 * f + k, " ".join(doc)))
                i = j
            else:
                i += 1
    assert got == want


LOG = """make: entering
In file included from a.h:3:
                 from main.c:7:
b.h:10:5: error: bad thing: here
   10 | int x
      |     ^
b.h:2: note: seen there
   one more
warn.c:4:2: warning: unused [-Wunused]
other.c:1:1: note: declared here

cc1: fatal error: no input
In file included from nowhere.h:1:
done"""


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_messages(spark, block):
    lines = [("x", i, t) for i, t in enumerate(LOG.split("\n"))] + [("y", 0, "a.c:1:2: note: alone"), ("y", 1, None), (None, 5, "n.c:1:1: error: e")]
    got = {(r["log"], r["n"]): r for r in dg.messages(spark.createDataFrame(lines, "log string, n int, text string"), block=block).collect()}
    assert {k: (r["type"], r["message"], r["path"], r["line"], r["col"], r["parent"]) for k, r in got.items()} == {
        ("x", 3): ("Error", "bad thing: here", "b.h", 10, 5, None), ("x", 6): ("Note", "seen there", "b.h", 2, None, 3), ("x", 8): ("Warning", "unused [-Wunused]", "warn.c", 4, 2, None),
        ("x", 9): ("Note", "declared here", "other.c", 1, 1, 8), ("x", 11): ("FatalError", "no input", None, None, None, None), ("y", 0): ("Note", "alone", "a.c", 1, 2, None), (None, 5): ("Error", "e", "n.c", 1, 1, None),
    }
    assert got["x", 3]["excerpt"] == "   10 | int x\n      |     ^" and got["x", 6]["excerpt"] == "   one more"
    assert got["x", 3]["included_from"] == ["a.h", "main.c"] and got["x", 11]["included_from"] == []
    files = spark.createDataFrame([(7, "b.h")], "file_id long, path string")
    log = dg.build_log(dg.messages(spark.createDataFrame(lines, "log string, n int, text string"), block=block), files)
    assert log.columns == [c.split()[0] for c in SCHEMAS["build_log"].split(", ")] and {r["start_line"] for r in log.where("file_id = 7").collect()} == {10, 2}


def test_no_messages(spark):
    assert dg.messages(spark.createDataFrame([], "log string, n int, text string")).count() == 0


def test_comments_windows_look_back(spark):
    """A frame up to the end of the partition is read again for each row: with a file's comments squared."""
    from srclake.sources import comments

    files = spark.createDataFrame([(1, "/** \\brief a */\nint x;\n/** \\brief b */\nint y;\nint z; /**< c */\n")], "file_id long, content string")
    nodes = spark.createDataFrame([(1, "Definition", 2, 1, 20), (1, "Definition", 4, 1, 40), (1, "Definition", 5, 1, 50)], "file_id long, ast_type string, start_line int, start_col int, entity_hash long")
    found = comments.documented(comments.extracted(files), nodes)
    assert sorted((r.entity_hash, r.content.strip()) for r in found.collect()) == [(20, "a"), (40, "b"), (50, "c")]
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_diagnostics_parse_each_line_twice_at_most(spark):
    """Values of other blocks are carried on; the plan reads the log once for the blocks and once for the lines."""
    text = ["  | lost", "In file included from a.h:1:", "                 from b.c:2:", "x.c:1:2: error: one", "  | 1", "  | 2", "x.c:2: note: two", "y.c:3:1: warning: three", "  | 3", "z.c:4:4: note: four"]
    lines = spark.createDataFrame([(log, i, t) for log in ("p", None) for i, t in enumerate(text)], "log string, n long, text string")
    want = [(3, "Error", "one", "  | 1\n  | 2", ["a.h", "b.c"], None), (6, "Note", "two", None, [], 3), (7, "Warning", "three", "  | 3", [], None), (9, "Note", "four", None, [], 7)]
    for block in (2, 3, 100):
        got = dg.messages(lines, block=block)
        rows = sorted((r["log"] or "", r["n"], r["type"], r["message"], r["excerpt"], r["included_from"], r["parent"]) for r in got.collect())
        assert rows == sorted((log, *w) for log in ("", "p") for w in want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
