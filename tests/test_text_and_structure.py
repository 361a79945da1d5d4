"""Text functions, HTML and Markdown parsing, ordered segment folds: exact expected values."""

import re

from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import context as cx
from tessella.operators import dedup as dd
from tessella.operators import folds as fd
from tessella.operators import markup as mk
from tessella.operators import structure as st
from tessella.operators import units as un


def plain_count(text):
    return len(re.findall("[^\\W_\u4e00-\u9fff]+", text)) + round(1.5 * len(re.findall("[\u4e00-\u9fff]", text)))


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


def test_tokens_and_counts(spark):
    t = F.col("t")
    assert one(spark, tx.tokens(t), t="SMF会话 v2.0-Ab") == ["smf", "会", "话", "v2", "0", "ab"]
    # 3 words and 3 CJK characters: 3 + round(4.5) = 3 + 4, half to even.
    assert one(spark, tx.token_count(t), t="one 会话中 two three") == 7
    assert one(spark, tx.token_count(t), t="") == 0
    for text in ("one 会话中 two three", "a_b-c d1", "中 x", ""):
        assert one(spark, tx.token_count(t), t=text) == plain_count(text)


def test_snapshot_text(spark):
    assert one(spark, tx.snapshot_text(F.col("t")), t="a  \r\n\r\n \n b\t\rc") == "a\n b\nc"


def test_clean_markup(spark):
    got = one(spark, tx.clean_markup(F.col("t")), t="**bold** [name](http://x(y)) ![img](a.png)<br/>x\n\n\n\ny ")
    assert got == "bold name \nx\n\ny"


def test_window_around(spark):
    got = one(spark, tx.window_around(F.col("t"), F.lit("needle"), 5, 5, "..."), t="0123456789 needle 0123456789")
    assert got == "...6789 needle 0123..."
    assert one(spark, tx.window_around(F.col("t"), F.lit("zz"), 5, 5, "..."), t="abc") == ""


def test_dedup_text(spark):
    assert one(spark, dd.dedup_text(F.col("t")), t="ＡＢＣ，  x_y! Ⅳ") == "abc x_y iv"


def test_char_ngrams_overlap(spark):
    assert sorted(one(spark, tx.char_ngrams(F.col("t"), 2), t="abab\nc")) == sorted(["ab", "ba", "b\n", "\nc"])


def test_html_to_markdown(spark):
    html = """<html><head><title>no</title></head><body><script>x()</script><h2>Head <b>x</b></h2><p>One <a href=u>link</a>
    two<p>next<ul><li>a<li>b <p>para</p></ul><pre>code
    line</pre><hr>tail</body></html>"""
    row = st.html_to_markdown(spark.createDataFrame([(1, "T", html)], "page_id long, title string, html string")).first()
    md = row["markdown"]
    assert md.startswith("# T\n\n## Head **x**\n\nOne link two\n\nnext")
    assert "- a\n- b\n" in md and "para" in md and "```\ncode" in md and "---" in md and "x()" not in md and row["error"] is None


def test_body_division_is_preferred(spark):
    html = "<body><div>menu</div><div class='topicBody'>core</div></body>"
    assert mk.page_markdown(html, "t") == "# t\n\ncore\n"


def test_headings_go_lower_and_images_get_a_prefix():
    html = "<h1>a</h1><h5>b</h5><img src='p/x.png' alt=i><img src='https://h/y.png'><img src='/z.png'><img src='#f'><img src='data:image/png;base64,A'>"
    assert mk.page_markdown(html, "t", 2, "pics") == ("# t\n\n### a\n\n###### b\n\n![i](pics/p/x.png)![](https://h/y.png)![](/z.png)![](#f)![](data:image/png;base64,A)\n")


def test_open_elements_close_where_others_begin():
    html = "<p>one<p>two<ul><li>a<li>b<ol><li>c</ol></ul><table><caption>Cap</caption><tr><td>x|y<td><table><tr><th>in</table><tr><td colspan=2>z</table>tail"
    got = mk.read_page(html)
    assert [(g.header, g.caption) for g in got.grids] == [(False, "Cap"), (True, "")]
    assert got.grids[0].lines == [["x\\|y", "\\| in \\| \\| --- \\|"], ["z", "z"]] and got.grids[1].lines == [["in"]]
    assert got.markdown().startswith("one\n\ntwo\n\n- a\n- b\n\n1. c\n") and got.markdown().endswith("tail")


def test_table_spans(spark):
    html = "<table><tr><th>a</th><th colspan=2>b</th></tr><tr><td rowspan=2>1</td><td>2</td><td>3</td></tr><tr><td>4</td><td>5</td></tr></table>"
    rows = st.html_table_cells(spark.createDataFrame([(7, html)], "id long, html string"), "id").collect()
    grid = {(r["row_index"], r["col_index"]): r["value"] for r in rows}
    assert [grid[0, c] for c in range(3)] == ["1", "2", "3"] and [grid[1, c] for c in range(3)] == ["1", "4", "5"]
    assert {r["column"] for r in rows} == {"a", "b"}


def test_every_table_and_bad_spans(spark):
    html = "<p>x</p><table><tr><td colspan=100000000>a</td></tr></table><table><tr><td rowspan=2>b</td><td>c</td></tr></table>"
    rows = st.html_table_cells(spark.createDataFrame([(1, html), (2, None), (3, "<div>" * 5000 + "<table><tr><td>d</td></tr></table>")], "id long, html string"), "id").collect()
    assert {r["table_index"] for r in rows if r["id"] == 1} == {0, 1}
    assert len([r for r in rows if r["table_index"] == 0 and r["id"] == 1]) == 1000
    assert {(r["row_index"], r["col_index"]): r["value"] for r in rows if r["table_index"] == 1} == {(0, 0): "b", (0, 1): "c", (1, 0): "b", (1, 1): ""}
    assert [r for r in rows if r["id"] == 3] and not [r for r in rows if r["id"] == 2]


def test_markdown_blocks():
    text = "# Top\nintro\nmore\n\n- one\n  - sub\n- two\n\n```py\nx = 1\n# no\n```\n> quote\n> more\n\n|a|b|\n|-|-|\n|1|2|\n|3|\n\n<table><tr></tr></table>\n\n1. x\n2. y\n## Sub ##\nend"
    b = st.markdown_blocks(text)
    assert [x[0] for x in b] == ["heading", "paragraph", "list", "code", "blockquote", "table", "html_table", "list", "heading", "paragraph"]
    assert b[0][1:5] == ("Top", 1, 0, 1) and b[1][1] == "intro\nmore"
    assert b[2][1] == "- one\n  - sub\n- two" and b[3][1] == "x = 1\n# no\n" and b[3][5] == "py"
    assert b[4][1] == "quote more" and b[5][1] == "a | b\n1 | 2\n3 | " and b[7][1] == "1. x\n2. y" and b[8][1:3] == ("Sub", 2)


def test_clause_numbers(spark):
    c = st.clause_number(F.col("t"))
    assert one(spark, st.heading_spacing(F.col("t")), t="4.2.1General  part") == "4.2.1 General part"
    assert one(spark, c, t="4.2.1 General") == "4.2.1" and one(spark, c, t="12 Scope") == "12"
    assert one(spark, c, t="5G core") is None and one(spark, c, t="Scope") is None


def words(n):
    return " ".join(["w"] * n)


def seg(text, kind="paragraph", path=("A",)):
    return kind, list(path), text


def folded(spark, segs, *steps):
    df = spark.createDataFrame([(1, segs), (2, [])], "doc_id int, segments array<struct<type string, path array<string>, text string>>")
    rows = fd.fold_segments(df, steps).collect()
    assert all(r.doc_id == 1 for r in rows) and sorted(r.segment_index for r in rows) == list(range(len(rows)))
    return sorted(rows, key=lambda r: r.segment_index)


def test_merge_small(spark):
    out = folded(spark, [seg(words(10)), seg(words(20)), seg(words(5), path=("B",)), seg(words(50), "table", ("B",)), seg(words(400), "table", ("B",)), seg(words(9), "code", ("B",))], "merge_small")
    assert [(r.block_type, r.token_count) for r in out] == [("paragraph", 30), ("table", 55), ("table", 400), ("code", 9)]
    assert out[0].raw_text == words(10) + "\n\n" + words(20) and [list(r.path) for r in out] == [["A"], ["B"], ["B"], ["B"]]


def test_merge_small_respects_the_cap(spark):
    assert len(folded(spark, [seg(words(450)), seg(words(90))], "merge_small")) == 2
    # 60 CJK characters count as 90 tokens; counts of a merged cell add up before they are rounded.
    assert [r.token_count for r in folded(spark, [seg("会"), seg("会"), seg("会 w")], "merge_small")] == [5]
    assert len(folded(spark, [seg(words(430)), seg("会" * 60)], "merge_small")) == 2


def test_a_list_takes_its_lead_and_a_big_table_does_not(spark):
    out = folded(spark, [seg(words(5)), seg(words(150), "list"), seg(words(4)), seg(words(301), "table"), seg(words(4)), seg(words(200))], "merge_small")
    assert [(r.block_type, r.token_count) for r in out] == [("list", 159), ("table", 301), ("paragraph", 4), ("paragraph", 200)]


def test_absorb_orphans_takes_nearest_ancestor_with_room(spark):
    segs = [seg(words(300), path=("A",)), seg(words(200), path=("A", "B")), seg(words(20), path=("A", "B", "C")), seg(words(20), "table", ("A", "B", "C"))]
    out = folded(spark, segs, "absorb_orphans")
    assert [r.token_count for r in out] == [300, 220, 20]
    assert out[1].raw_text == words(200) + "\n\n" + words(20)
    full = [seg(words(500), path=("A",)), seg(words(50), path=("A", "B"))]
    assert [r.token_count for r in folded(spark, full, "absorb_orphans")] == [500, 50]


def test_orphans_move_last_first_and_take_what_they_absorbed_along(spark):
    segs = [seg("root " + words(199), path=()), seg("one", path=("A",)), seg("two", path=("A", "B")), seg("three", path=("C",))]
    out = folded(spark, segs, "absorb_orphans")
    assert [r.raw_text for r in out] == ["\n\n".join(["root " + words(199), "three", "one", "two"])]
    # Equally near hosts: the earlier one.
    near = [seg(words(150), path=("A",)), seg("x", path=("A", "B")), seg(words(160), path=("A",))]
    assert [r.token_count for r in folded(spark, near, "absorb_orphans")] == [151, 160]


def test_merge_lead_ins(spark):
    segs = [seg("Parts:", path=("A",)), seg(words(200), path=("A", "B")), seg("Tail", path=("C",)), seg(words(5), "table", ("C", "D"))]
    out = folded(spark, segs, "merge_lead_ins")
    assert out[0].raw_text.startswith("Parts:\n\nw") and [r.block_type for r in out] == ["paragraph", "paragraph", "table"]
    assert [r.raw_text for r in folded(spark, [seg("a", path=("A",)), seg("b", path=("A", "B")), seg("c", path=("A",))], "merge_lead_ins")] == ["a\n\nb\n\nc"]


def test_split_large(spark):
    long = "\n\n".join([words(300), words(300), "。".join([words(200)] * 4)])
    out = folded(spark, [seg(long), seg("x")], *fd.STEPS[-1:])
    assert [r.token_count for r in out] == [300, 300, 400, 400, 1]


def test_all_folds_run_on_one_row(spark):
    segs = [seg("Intro", path=("A",)), seg(words(700), path=("A", "B")), seg("t " * 20, "table", ("A", "B")), seg("end.", path=("Z",))]
    assert [r.token_count for r in folded(spark, segs, *fd.STEPS)] == [1, 700, 20, 1]


def test_entity_cards_limit_moves_on():
    refs = [{"segment_index": i, "type": "t", "name": n} for i, n in [(0, "a"), (0, "b"), (0, "c"), (1, "a"), (1, "c")]]
    assert un._claim(refs, 2) == [0, 1, 4]


def summary(spark, text, allowed, query, keywords=None):
    """The summary of one item that is too long beside a seed that fills its query's budget."""
    items = spark.createDataFrame([(1, "s", "seed", "x" * 100), (1, "o", "support", text)], "query_id int, item_id string, role string, text string")
    columns = "query_id int, query string" + (", keywords array<string>" if keywords else "")
    queries = spark.createDataFrame([(1, query, keywords)[:3 if keywords else 2]], columns)
    b = cx.compress(items, queries, max_chars=1).where("role <> 'seed'")
    assert allowed == 100
    return b.first().text


def test_summary_keeps_original_order(spark):
    pad = "z" * 60
    text = f"alpha beta.! {pad} gamma delta! query words here! {pad} omega!"
    assert summary(spark, text, 100, "query words") == f"alpha beta.! query words here! {pad} omega!"
    assert summary(spark, text, 100, "xx", ["alpha", "beta"]) == f"alpha beta.! {pad} gamma delta!"
    # One sentence, or nothing to look for: the text is truncated.
    assert summary(spark, "q" * 120, 100, "query") == "q" * 100 + "..."
    assert summary(spark, text, 100, "q") == text[:100] + "..."
    # Nothing fits: the best sentence is cut.
    long = "a" * 110 + "! query " + "b" * 110 + "!"
    assert summary(spark, long, 100, "query") == ("query " + "b" * 110 + "!")[:100]

