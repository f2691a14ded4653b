from docloom.operators import markdown as M

SAMPLE = """**CUI//TEST**

# Title

First line
second line [here](https://example.com/x).

## List

- one
- two *it*
1. first

| A | B |
| --- | --- |
| 1 | x \\| y |

```
def f():
    return 1   
```

> quoted
> more

---
<!-- gone -->
Last `code` **bold** [local](a.md) [https://a.b](https://a.b)
"""


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_blocks(spark):
    rows = [(r.kind, r.level, r.value) for r in M.blocks(_docs(spark, SAMPLE)).orderBy("ordinal").collect()]
    assert rows[0] == ("banner", None, "CUI//TEST")
    assert rows[1] == ("heading", 1, "Title")
    assert rows[2] == ("paragraph", None, "First line second line here (https://example.com/x).")
    assert [r[0] for r in rows[3:]] == ["heading", "bullet", "bullet", "numbered", "table", "code", "blockquote", "paragraph"]
    assert rows[-3][2] == "def f():\n    return 1"
    assert rows[-2][2] == "quoted more"
    assert rows[-1][2].endswith("local https://a.b")


def test_canonical_form_is_stable_and_ends_with_one_newline(spark):
    once = M.canonical(_docs(spark, SAMPLE)).first().markdown
    again = M.canonical(_docs(spark, once)).first().markdown
    assert once == again and once.endswith("\n") and not once.endswith("\n\n")
    assert "| 1 | x \\| y |" in once and "gone" not in once and "---\n<" not in once


def test_crlf_and_byte_order_mark_do_not_count(spark):
    a, b = (M.canonical(_docs(spark, t)).first().markdown for t in ("# A\n\nb\nc\n", "﻿# A\r\n\r\nb\r\nc\r\n"))
    assert a == b


def test_refusals(spark):
    bad = {
        "IMAGE": "![x](y)", "INDENTED-CODE": "a\n\n    code", "NESTED-LIST": "  - x", "HARD-BREAK": "a  \nb", "SETEXT-HEADING": "Title\n===", "HEADING-LEVEL": "##### x",
        "HTML-COMMENT": "<!-- open", "FENCE-INFO": "```py", "NESTED-BLOCKQUOTE": "> > x", "UNCLOSED-FENCE": "```\nx",
    }
    found = {r.doc_id: r.code for r in M.refusals(_docs(spark, *bad.values(), "fine\n\n# ok")).collect()}
    assert found == dict(enumerate(bad))


def test_fenced_lines_are_not_judged(spark):
    assert M.refusals(_docs(spark, "```\n    a  \n![x](y)\n```")).count() == 0


def test_empty_and_null_texts(spark):
    got = {r.doc_id: r.markdown for r in M.canonical(_docs(spark, "", None)).collect()}
    assert got == {0: "\n", 1: "\n"}


def test_inline_segments(spark):
    row = spark.createDataFrame([("a **b** *c* `d`",)], "v string").select(M.inline_segments("v").alias("s")).first().s
    assert [(x["style"], x["text"]) for x in row if x["text"].strip()] == [("plain", "a "), ("bold", "b"), ("italic", "c"), ("code", "d")]
