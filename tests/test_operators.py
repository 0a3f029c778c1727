from pyspark.sql import functions as F

from inkcell.functions import tags
from inkcell.operators import annotations, compare, layout, lines, nav, physical, semantics
from inkcell.plans import pipeline


def texts(spark, *xs):
    return spark.createDataFrame(list(enumerate(xs)), "doc_id int, text string")


def parsed(spark, x):
    return [(r.page_index, r.line_index, r.raw_ascii) for r in lines.parse(texts(spark, x)).orderBy("global_index").collect()]


def test_parse(spark):
    assert [x[2] for x in parsed(spark, "a\n\nb\n")] == ["a", "", "b"]
    assert [x[:2] for x in parsed(spark, "page1\n\x0cpage2\n")] == [(0, 0), (1, 0)]
    assert parsed(spark, "") == [] and [x[2] for x in parsed(spark, "\n")] == [""]
    assert [x[2] for x in parsed(spark, "a\r\nb\rc")] == ["a", "b", "c"]


def test_serialize(spark):
    docs = texts(spark, "a\n\nb\n", "p\n\x0c\x0cq\n", "x\n\x0c", "")
    back = {r.doc_id: r.text for r in lines.serialize(lines.parse(docs), lines.documents(docs)).collect()}
    assert back == {0: "a\n\nb\n", 1: "p\n\x0c\x0cq\n", 2: "x\n\x0c", 3: ""}


def compared(spark, a, b, **kw):
    return compare.compare_lines(lines.parse(texts(spark, a)), lines.parse(texts(spark, b)), **kw)


def test_compare(spark):
    s = compare.summary(compared(spark, "abc\ndef\x0cghi", "abc\ndef\x0cghi")).first()
    assert (s.matched_lines, s.cell_match_ratio, s.line_match_ratio) == (3, 1.0, 1.0)
    d = compared(spark, "hello\nworld", "hello\nworlx")
    assert compare.first_diffs(d).select("line_index", "cell_equal", "cell_total").collect() == [(1, 4, 5)]
    assert compared(spark, "a\x0cb", "a\x0cc", page_limit=1).count() == 1
    blank = compare.summary(compared(spark, "a\n\n", "a")).first()
    assert (blank.matched_lines, blank.cell_equal, blank.cell_total) == (2, 2, 2)
    assert "matched 1" in compare.report(d).first().report


def views(spark, rows):
    return spark.createDataFrame([(0, i, a, k) for i, (a, k) in enumerate(rows)], "doc_id int, global_index int, raw_ascii string, ink string")


def test_segments_and_diff(spark):
    ref = compare.segments(compare.line_views(views(spark, [("x", "안내 사항"), ("82#a`9#c;0", "[1~3]"), ("y", "본문"), ("#a4 z", "1. 가나다라"), ("#b4 z", "2. 라")])))
    gen = compare.segments(compare.line_views(views(spark, [("82#a`9#c;0", "[1~3]"), ("y", "본문"), ("#a4 z", "1. 하파타카")])))
    got = {(r.classification, r.key) for r in compare.compare_segments(gen, ref, 0.9).collect()}
    assert got == {("expected_guidance", "guidance:preamble"), ("aligned_ok", "passage:1-3"), ("content_mismatch", "question:1"), ("missing_in_generated", "question:2")}
    s = compare.segment_summary(compare.compare_segments(gen, ref, 0.9)).first()
    assert (s.aligned, s.aligned_ok, s.missing_in_generated) == (2, 1, 1)


def blocks(spark, tags_, doc=0):
    rows = [(doc, 1, i, f"b{i}", f"{'[1~3] ' if t == 'PassageGroup' else ''}text {i}", t) for i, t in enumerate(tags_)]
    return spark.createDataFrame(rows, "doc_id int, page_number int, reading_order int, id string, text string, tag string")


def test_tree(spark):
    five = ["Choice"] * 5
    nodes = semantics.tree(semantics.assign(blocks(spark, ["PassageGroup", None, None, "Question", *five, "Question", *five])))
    assert {r.node_type: r.n for r in semantics.counts(nodes).collect()} == {"PassageGroup": 1, "Passage": 2, "Question": 2, "Choice": 10}
    assert semantics.relations(nodes).count() == 2 and semantics.warnings(nodes).count() == 0
    g = nodes.where("node_type = 'PassageGroup'").first()
    assert (g.node_id, g.start_question, g.end_question, g.depth) == ("passage-group-1", 1, 3, 1)


def test_tree_warnings_and_order(spark):
    nodes = semantics.tree(semantics.assign(blocks(spark, ["Header", "PassageGroup", "Choice", None, "Footer", "Question", "Choice", "Choice"])))
    top = [r.node_type for r in nodes.where("depth = 1").orderBy("dfs_order").collect()]
    assert top == ["Header", "Unknown", "PassageGroup", "Footer", "Question"]  # a group is placed when it closes
    assert [r.warning for r in semantics.warnings(nodes).orderBy("nth").collect()] == ["unclassified blocks: 1", "question b5: expected 5 choices, found 2", "questions outside PassageGroup: 1"]
    assert "Unknown (b2)" in semantics.tree_text(nodes).first().tree and "unclassified 1" in semantics.summary(nodes).first().summary
    assert semantics.all_unknown(blocks(spark, [None, "Question"])).count() == 2


def test_layout(spark):
    seqs = spark.createDataFrame([(0, 0, "a", "PassageGroup", "abc", False), (0, 1, "b", "Choice", "abcdefghij klmno", False)], "doc_id int, seq_no int, node_id string, node_type string, ascii string, preformatted boolean")
    rows = [r.ascii_text for r in layout.rows(seqs, 10).orderBy("row_no").collect()]
    assert rows[0] == "" and rows[1] == "  abc" and rows[2].startswith("=g") and rows[3].startswith("  abcdefgh") and all(len(r) <= 32 for r in rows)
    many = spark.createDataFrame([(0, i, "n", "" if i == 0 else f"r{i}") for i in range(14)], "doc_id int, row_no int, node_id string, ascii_text string")
    cut = [(r.page_index, r.line_index, r.ascii_text) for r in layout.paginate(many, 6).orderBy("page_index", "line_index").collect()]
    assert [x[2] for x in cut if x[0] == 1] == ["", "r6", "r7", "r8", "r9", "r10"] and (2, 1, "r12") in cut  # r11 is pushed off
    full = [r.ascii_text for r in layout.paginate(many, 6, compat_truncate=False).orderBy("page_index", "line_index").collect()]
    assert [x for x in full if x] == [f"r{i}" for i in range(1, 14)]


def tree_nodes(spark):
    nodes = semantics.tree(semantics.assign(blocks(spark, ["PassageGroup", None, "Question", "Choice", "Choice", "Question"])))
    return semantics.with_root(nodes, spark.createDataFrame([(0, "x.pdf")], "doc_id int, source_path string"))


def test_navigation(spark):
    index = nav.index(tree_nodes(spark)).cache()
    c = nav.Cursor(index, 0)
    assert c.at == "passage-group-1" and c.first_child().node_id == "b1"
    c.go("b2")
    assert c.step("Question").node_id == "b5" and c.step("Question") is None
    c.go("b3")
    assert c.next_sibling().node_id == "b4" and c.prev_sibling().node_id == "b3" and c.prev_sibling() is None
    assert c.go("nowhere") is None and c.at == "b3"
    c.mark_origin()
    c.reset()
    assert c.go_origin().node_id == "b3"
    crumbs = {r.node_id: r.crumbs for r in nav.breadcrumb(tree_nodes(spark)).collect()}
    assert crumbs["b3"] == ["passage-group-1", "b2"] and crumbs["passage-group-1"] == [] and crumbs["exam-root"] == []
    held = tree_nodes(spark).withColumn("block_ids", F.array(F.lit("k")))
    assert nav.find_by_block(held).first().node_id == "b3"
    c = nav.Cursor(nav.index(held).cache(), 0)
    assert c.go_block("k").node_id == "b3" and c.go_block("none") is None and c.at == "b3"
    place = {r.node_id: r for r in nav.locations(index).collect()}
    assert place["b3"].summary.startswith("PassageGroup > Question > Choice: ") and place["b2"].child_ids == ["b3", "b4"] and place["exam-root"].child_ids == ["passage-group-1"]


def spans(spark, rows):
    data = [(0, p, f"s{i}", t, float(x), float(y), float(x + 5 * len(t)), float(y + 11), 11.0, i) for i, (p, t, x, y) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id int, page_number int, id string, text string, x0 double, y0 double, x1 double, y1 double, font_size double, extraction_index int")


def two_columns(spark):
    rows = []
    for p in (1, 2, 3):
        rows += [(p, "Title", 90, 120), (p, "Sub", 90, 140), (p, "━" * 40, 90, 160), (p, "left one " * 4, 90, 200), (p, "left two " * 4, 90, 230), (p, "right one", 450, 200), (p, "right two", 450, 230), (p, str(p), 400, 1100), (p, "16", 420, 1105)]
    return spans(spark, rows), spark.createDataFrame([(0, 841.0, 1190.0)], "doc_id int, page_width double, page_height double")


def test_profile_and_order(spark):
    sp, sizes = two_columns(spark)
    p = physical.infer_profile(sp, sizes).first()
    assert 300 < p.column_cut_x < 500 and p.header_bottom_y < 250 and p.footer_top_y > 1000
    made = pipeline.structure(sp, sizes).where("page_number = 1").orderBy("reading_order").collect()
    assert [r.col for r in made] == sorted((r.col for r in made), key=[-2, -1, 0, 1, 2].index)
    assert made[0].candidate_tags == ["Header"] and made[-1].candidate_tags == ["Footer"]


def test_lines_fold_with_running_mean(spark):
    # in the order of y0 and x0: a, d, b, c; d is too far to the right of a, b is left of d's edge and within its
    # height (mean 102 then), c is 5 below that mean
    sp = spans(spark, [(1, "a", 10, 100), (1, "b", 40, 104), (1, "c", 70, 107), (1, "d", 300, 100)])
    got = [r.text for r in physical.build_lines(physical.assign_columns(sp)).orderBy("reading_order").collect()]
    assert sorted(got) == ["a", "bd", "c"]


def page_blocks(spark):
    none = F.array().cast("array<string>")
    rows = [(0, 1, f"p1-b{i}", f"t{i}", 0.0, 10.0 * i, 5.0, 10.0 * i + 8, [f"l{2 * i}", f"l{2 * i + 1}"], i) for i in range(3)]
    b = spark.createDataFrame(rows, "doc_id int, page_number int, id string, text string, x0 double, y0 double, x1 double, y1 double, line_ids array<string>, reading_order int")
    return b.withColumns({"candidate_tags": F.array(F.lit("Choice")), "tags": none, "notes": F.lit(None).cast("string")})


def test_block_edits(spark):
    b = page_blocks(spark)
    pair = spark.createDataFrame([(0, 1, "p1-b2", "p1-b1")], "doc_id int, page_number int, left_id string, right_id string")
    m = physical.merge_blocks(b, pair).orderBy("reading_order").collect()
    assert [(r.id, r.text, r.candidate_tags) for r in m] == [("p1-b0", "t0", ["Choice"]), ("p1-b1", "t1\nt2", ["Choice"])]
    lines_ = spark.createDataFrame([(0, 1, f"l{i}", f"x{i}", 0.0, float(i), 1.0, i + 1.0) for i in range(6)], "doc_id int, page_number int, id string, text string, x0 double, y0 double, x1 double, y1 double")
    cut = spark.createDataFrame([(0, 1, "p1-b0", "l0"), (0, 1, "p1-b1", "l3")], "doc_id int, page_number int, id string, after_line_id string")
    s = {r.id: r for r in physical.split_blocks(b, lines_, cut).collect()}
    assert s["p1-b0"].text == "x0" and s["p1-b0-split"].text == "x1" and s["p1-b0-split"].candidate_tags == [] and "p1-b1-split" not in s
    move = lambda to: [r.id[-1] for r in physical.move_block(b, spark.createDataFrame([(0, 1, "p1-b0", to)], "doc_id int, page_number int, id string, to int")).orderBy("reading_order").collect()]
    assert move(1) == ["1", "0", "2"] and move(9) == ["1", "2", "0"] and move(-1) == ["0", "1", "2"]
    n = physical.nudge_block(b, spark.createDataFrame([(0, 1, "p1-b2", -1)], "doc_id int, page_number int, id string, by int"))
    assert [r.id[-1] for r in n.orderBy("reading_order").collect()] == ["0", "2", "1"]


def test_annotations(spark):
    rows = spark.createDataFrame([(0, i, 0, i, [], "old") for i in range(3)], "doc_id int, global_index int, page_index int, line_index int, tags array<string>, notes string").withColumn("candidate_tags", F.array(F.lit("C")))
    notes = spark.createDataFrame([(0, 0, 1, ["A"], "n"), (0, 1, 1, ["B"], None), (0, 2, 9, ["Z"], "x")], "doc_id int, nth int, global_index int, tags array<string>, notes string")
    got = {r.global_index: (r.tags, r.notes) for r in annotations.apply(rows, notes).collect()}
    assert got == {0: ([], "old"), 1: (["B"], None), 2: ([], "old")}
    assert annotations.applied_count(rows, notes).first().applied == 2
    assert annotations.export(annotations.apply(rows, notes)).count() == 3
    assert annotations.accept_candidates(annotations.apply(rows, notes)).where("global_index = 0").first().tags == ["C"]
    js = annotations.export_json(rows, spark.createDataFrame([(0, "a.brf")], "doc_id int, source_path string")).first().json
    assert '"version":1' in js and '"line_count":3' in js


def test_pipeline(spark):
    rows = [(0, 1, i, f"b{i}", x) for i, x in enumerate(["[1~3] 다음 글을 읽고 물음에 답하시오.", "지문 본문입니다", "1. 물음입니다", *(f"{c} 선택" for c in "①②③④⑤"), "12"])]
    b = spark.createDataFrame(rows, "doc_id int, page_number int, reading_order int, id string, text string")
    b = b.withColumns({"candidate_tags": tags.block_candidates(F.col("text")), "tags": F.array().cast("array<string>"), "notes": F.lit(None).cast("string")})
    out = pipeline.convert_blocks(b)
    assert {r.node_type for r in out.nodes.collect()} >= {"PassageGroup", "Passage", "Question", "Choice"}
    text = out.text.first().text
    assert "82#a`9#c;0" in text and "7#e7" in text and "=gggg" in text
    same = pipeline.compare_content(out.text, out.text)
    assert {r.classification for r in same.collect()} == {"aligned_ok"}
    assert pipeline.stand_in(b).text.count() == 1


def test_sampled_pages(spark):
    rows = spark.createDataFrame([(d, p) for d, n in ((0, 4), (1, 2), (2, 1)) for p in range(1, n + 1)], "doc_id int, page_number int")
    seen = lambda k: sorted(tuple(r) for r in physical.sample(rows, k).collect())
    assert seen(2) == [(0, 2), (0, 3), (1, 1), (1, 2), (2, 1)] and seen(4) == sorted(tuple(r) for r in rows.collect())


def test_own_cuts(spark):
    lines = spark.createDataFrame([(0, 1, f"l{i}", x, x + 100.0, 10.0 * i, 10.0 * i + 8) for i, x in enumerate([0.0, 0.0, 0.0, 130.0, 130.0, 130.0])] + [(0, 2, "m", 0.0, 90.0, 0.0, 8.0)], "doc_id int, page_number int, id string, x0 double, x1 double, y0 double, y1 double")
    assert physical.line_cuts(lines).collect()[0].cut == 115.0 and physical.block_cuts(lines).count() == 1
    placed = {r.id: r.col for r in physical.assign_columns(lines, cuts=physical.line_cuts(lines)).collect()}
    assert placed == {"l0": 0, "l1": 0, "l2": 0, "l3": 1, "l4": 1, "l5": 1, "m": 0}
