import io
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorevane.operators import refine, vector
from lorevane.sources import blocks, docx, files, llm_json


def blocks_of(spark, f, text):
    return [tuple(b) for b in spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]]


def test_markdown(spark):
    md = "intro\n# One #\nbody\r\n#no\nSetext\n===\nx\n\n---\ny\n##### five\nTwo\n---\nz\n# \n### \tthree"
    assert blocks_of(spark, blocks.markdown, md) == [
        (1, "文档", "intro"), (1, "One", "body\n#no"), (1, "Setext", "x"), (1, "Setext", "y\n##### five"), (2, "Two", "z\n#")]
    assert blocks_of(spark, blocks.markdown, "#\t") == [(1, "文档", "#")]


def test_html(spark):
    got = blocks_of(spark, blocks.html, "<title>t</title><H2 class=x>A <b>bold</b></H2><p>one &amp; two</p><script>var s='</p>'</script><h1>B</h1>end")
    assert got == [(1, "文档", "t"), (2, "A  bold", "one &amp; two"), (1, "B", "end")]


def test_plain(spark):
    long = "字" * 81
    assert [b[2] for b in blocks_of(spark, blocks.plain, f"{long}\n\nshort\n\nmore\n")] == [long, "short\n\nmore\n"]
    assert [len(b[2]) for b in blocks_of(spark, blocks.plain, "\n".join(["x" * 999] * 5))] == [2999, 1999]
    assert blocks_of(spark, blocks.plain, "  \n ") == []


def test_long_blocks_overlap(spark):
    text = "\n".join(f"{i:03}" + "a" * 197 for i in range(10))
    parts = spark.createDataFrame([(text,)], "t string").select(blocks.split_long(F.col("t"))).first()[0]
    assert len(parts) > 1 and all(len(p) <= 941 for p in parts)
    assert all(b.startswith(a[-39:]) for a, b in zip(parts, parts[1:]))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="a。；\n b", max_size=1500), min_size=1, max_size=4))
def test_windows(spark, bodies):
    rows = spark.createDataFrame([(b,) for b in bodies], "t string").select("t", vector.windows(F.col("t")).alias("w")).collect()
    for r in rows:
        assert all(0 < len(w) <= 400 for w in r.w)
        out, start, t = [], 0, r.t
        if len(t) <= 400:
            out = [t.strip()] if t.strip() else []
        else:
            while start < len(t):
                cut = end = min(start + 400, len(t))
                if end < len(t):
                    cut = next((k + 1 for k in range(end - 1, start + 199, -1) if t[k] in "。！？；\n"), end)
                out += [s] if (s := t[start:cut].strip()) else []
                if cut >= len(t):
                    break
                start = max(cut - 50, start + 1)
        assert list(r.w) == out


def docx_bytes(xml):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    return data.getvalue()


def test_docx(spark):
    good = docx_bytes("<w:document><w:p><w:pPr><w:pStyle w:val=\"标题1\"/></w:pPr><w:r><w:t>门</w:t></w:r></w:p><w:p><w:r><w:t>这是一段足够长的正文，用来检查。</w:t></w:r></w:p></w:document>")
    d = spark.createDataFrame([(1, good), (2, b"no zip"), (3, docx_bytes("<w:p></w:p>"))], "id int, content binary").withColumn("x", docx.unzip("content"))
    rows = {r.id: r for r in d.select("id", "x.error", docx.blocks_from_xml(F.col("x.xml")).alias("b")).collect()}
    assert [tuple(b) for b in rows[1].b] == [(1, "门", "这是一段足够长的正文，用来检查。")]
    assert "not a valid .docx" in rows[2].error and rows[3].b == []


def test_decode(spark):
    d = spark.createDataFrame([("港口".encode("gb18030"),), ("港口".encode(),)], "b binary")
    assert [r[0] for r in d.select(files.decode(F.col("b"))).collect()] == ["港口", "港口"]


def test_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.md", "y.txt", "old.doc", "pic.png"):
        (tmp_path / name).write_text("text")
    rows = {r.rel_path or r.path: r for r in files.scan(spark, [str(tmp_path), str(tmp_path / "none")]).collect()}
    assert {k: r["class"] for k, r in rows.items()} == {"a/x.md": "doc", "y.txt": "doc", "old.doc": "unsupported", "pic.png": "skip", str(tmp_path / "none"): "missing"}
    assert rows["pic.png"].content is None and rows["y.txt"].content == b"text"


def test_heading_paths(spark):
    d = spark.createDataFrame([([(1, "a", "x"), (2, "b", "x"), (3, "c", "x"), (2, "d", "x")],)], f"b {blocks.NONE}")
    assert d.select(blocks.heading_paths(F.col("b"), F.lit("s"))).first()[0] == ["s / a", "s / a / b", "s / a / b / c", "s / a / d"]


def test_local_split(spark):
    text = "灰港\n灰港是北方的一座港口，常年有雾。\n\n铁门\n铁门守着山口，商队都要在这里缴费。"
    e = spark.createDataFrame([(text,)], "t string").select(refine.local_split(F.col("t")).alias("e"), refine.coverage(refine.local_split(F.col("t")), F.col("t")).alias("c")).first()
    assert [x.title for x in e.e] == ["灰港", "铁门"] and e.c >= 50


def test_segments_and_pieces():
    body = "a。" * 400 + "\n\n  second  \nthird"
    segs = refine.segments(body)
    assert all(b - a <= 501 for a, b in segs) and body[slice(*segs[-2])] == "second"
    packed = refine.pieces(body, segs, most=600)
    assert packed[0][2].startswith("[000] ") and packed[0][1] + 1 >= packed[1][0] and packed[-1][1] == len(segs) - 1
    assert refine.pieces("", []) == []


SOURCE = "\n".join(["引子" * 25 + "。", "铁砧堡扼守山口，是防御核心，常年驻军。", "城主荀岚兼管税收，行事谨慎，不轻信人。", "商队过山口必须缴费，否则不得通行。"])


def test_materialize():
    by_number = refine.materialize(SOURCE, [{"title": "铁砧堡", "start": 1}, {"title": "荀岚", "start": 2, "aliases": ["城主"]}])
    assert [e["title"] for e in by_number] == ["本章前言", "铁砧堡", "荀岚"] and by_number[2]["body"].endswith("通行。")
    assert all(e["body"] in SOURCE for e in by_number)
    fuzzy = refine.materialize(SOURCE, [{"title": "x", "start": -1, "anchor": "铁砧堡扼守山口，是防御的核心，常年驻军"}])
    assert fuzzy[-1]["body"].startswith("铁砧堡")
    twice = refine.materialize(SOURCE, [{"title": "铁砧堡", "start": 1, "aliases": ["a"]}, {"title": "堡", "start": 1, "aliases": ["b"]}])
    assert twice[-1]["aliases"] == ["a", "b"]
    assert refine.materialize(SOURCE, [{"title": "没有的词", "start": -1}]) == []


def test_replies(spark):
    raw = ['text [{"title":"A","start":"[002]"}] more', "```\n{\"entries\":[{\"title\":\"B\"}]}\n```", "[]", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "r string").select(llm_json.parse_entries(F.col("r"))).collect()]
    assert got[0][0].start == 2 and got[1][0].title == "B" and got[2] is None and got[3] is None


def test_settings_and_judgements(spark, tmp_path):
    assert llm_json.settings(str(tmp_path / "s.toml")) is None and (tmp_path / "s.toml").exists()
    (tmp_path / "f.toml").write_text('base_url = "http://x"\nmodel = "m"\n')
    assert llm_json.settings(str(tmp_path / "f.toml"))["model"] == "m"
    (tmp_path / "e.jsonl").write_text('# c\n\n{"query":"q","relevant_chunk_ids":["t"],"kind":"lexical","must_extract_any":[]}\n{"query":"r","kind":"other"}\n')
    assert [r.query for r in llm_json.judgements(spark, str(tmp_path / "e.jsonl")).collect()] == ["q"]
    cache = spark.createDataFrame([("k", "r")], "key string, reply string")
    asked = spark.createDataFrame([("k", "r"), ("n", "s"), ("f", None)], "key string, reply string")
    assert [r.key for r in llm_json.remember(cache, asked).collect()] == ["n"]
    assert llm_json.cached(asked.select("key"), cache).where("reply is null").count() == 2


class Good:
    def split_many(self, chapters):
        return [[{"title": "铁砧堡", "start": 1, "aliases": ["山口要塞"]}, {"title": "荀岚", "start": 2, "entity_type": "npc"}] for _ in chapters]


class Hopeless:
    def split_many(self, chapters):
        return [ValueError("no reply") for _ in chapters]


def test_model_split(spark):
    text = SOURCE + "\n" + "补充说明，内容很长。" * 100
    b = spark.createDataFrame([(1, "s", 0, 1, "第一章", text)], "doc_id long, stem string, block int, level int, title string, text string")
    drafts, notes = refine.drafts(b, make=Good)
    rows = drafts.orderBy("ordinal").collect()
    assert [r.title for r in rows] == ["本章前言", "铁砧堡", "荀岚"] and notes.count() == 0
    assert sum(len(r.body) for r in rows) >= 0.95 * len(text)
    assert rows[1].parent_path == "s / 第一章 / 铁砧堡" and rows[1].names == ["山口要塞"] and rows[2].entity_type == "npc"
    drafts, notes = refine.drafts(b, make=Hopeless)
    assert [r.title for r in drafts.collect()] == ["第一章"] and "no reply" in notes.first().note


def test_lead_ins(spark):
    rows = [(1, 0, "k0", "other", "温度分层", "分层如下：", "s / 章 / 温度分层", 1, []), (1, 1, "k1", "other", "第一层", "很冷。", "s / 章 / 第一层", 1, []), (1, 2, "k2", "other", "别处", "x：", "s / 别 / 别处", 1, []), (1, 3, "k3", "other", "尾", "y", "s / 章 / 尾", 1, [])]
    d = spark.createDataFrame(rows, "doc_id long, ordinal int, stable_key string, entity_type string, title string, body string, parent_path string, visibility long, names array<string>")
    got = refine.lead_ins(d).orderBy("ordinal").collect()
    assert [(r.ordinal, r.title, r.body) for r in got] == [(0, "第一层", "分层如下：\n很冷。"), (1, "别处", "x："), (2, "尾", "y")] and got[0].names == ["温度分层"]


def test_headings_do_not_nest(spark):
    d = spark.createDataFrame([("x<h2>a<h1>b</h1>c</h2>body",), ("<H3 id=1>\n t <i>u</i></h4>v<h1>w",)], "h string")
    got = [r[0] for r in d.select(blocks.html_text(F.col("h"))).collect()]
    assert [" ".join(x.split(" ")).strip() for x in got] == ["x\n## a b\nc body", "### t  u \nv w".replace(" \n", "\n")]


WORD = {
    "<w:p><w:r><w:t>one line that is certainly no heading</w:t><w:br/><w:t xml:space=\"preserve\"> goes on</w:t></w:r></w:p>": [(1, "文档", "one line that is certainly no heading goes on")],
    "<w:p><w:r><w:t>a line with<w:br/>a break and<w:tab/>a tab inside, long enough</w:t></w:r></w:p>": [(1, "文档", "a line with\na break and a tab inside, long enough")],
    "<w:p><w:pPr><w:outlineLvl w:val='1'/></w:pPr><w:r><w:t>灯塔</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>灯塔是港口里唯一的路标，常年亮着。</w:t></w:r></w:p>": [(2, "灯塔", "灯塔是港口里唯一的路标，常年亮着。")],
    # A text that is never closed ends with its paragraph, and shows nothing of the tags in it.
    "<w:p><w:r><w:t>第1章 接受任务<w:rPr><w:rFonts w:ascii=\"x\"/></w:r></w:p><w:p><w:r><w:t>他们在灰港的酒馆里接受了这个任务。</w:t></w:r></w:p>": [(1, "第1章 接受任务", "他们在灰港的酒馆里接受了这个任务。")],
    # Deleted text and field codes are unseen; a table's row is a line, empty cells at its end go.
    "<w:p><w:r><w:t>这一段足够长，不会被当成标题。</w:t></w:r><w:del><w:r><w:t>删掉</w:t></w:r></w:del><w:r><w:instrText>PAGE</w:instrText></w:r></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>别名</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>小玛</w:t></w:r></w:p><w:p><w:r><w:t>玛拉</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr>"
    "<w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>": [(1, "文档", "这一段足够长，不会被当成标题。\n别名：小玛 玛拉")],
    # Entities are read; what then looks like a tag goes.
    "<w:p><w:r><w:t>x &amp;amp; y &lt;b&gt;  z, and so on until the line is long</w:t></w:r></w:p>": [(1, "文档", "x &amp; y z, and so on until the line is long")],
    "no paragraph <w:t>at all</w:t>": [], "<w:p><w:r><w:t>cut off": [], "": [],
}


def test_word_reader():
    for xml, want in WORD.items():
        assert docx.read(f"<w:document><w:body>{xml}</w:body></w:document>" if xml else xml) == want, xml


def test_long_texts_take_linear_time():
    import time

    text = ("字 word. " * 60 + "\n") * 8000  # 4 million characters
    one_line = "x" * 4_000_000
    for f in (vector.windows_of, blocks.overlapped, blocks.paragraphs, blocks.headed, refine.local_entries, refine.segments):
        for t in (text, one_line):
            began = time.perf_counter()
            f(t)
            assert time.perf_counter() - began < 8, f


def test_highlight_takes_any_query(spark):
    from lorevane.functions import text as T

    d = spark.createDataFrame([(r"a\Eb a\Eb", r"\E"), ("a.b axb", "a.b"), ("aaa", "aa"), ("x", " ")], "t string, q string")
    got = [[tuple(s) for s in r[0]] for r in d.select(T.highlight(F.col("t"), F.col("q"))).collect()]
    assert got == [[(1, 3), (6, 8)], [(0, 3)], [(0, 2)], []]


def test_a_batch_is_not_held_as_objects():
    """The Python objects of a large batch are those of one part of it."""
    import tracemalloc

    import pyarrow as pa

    from lorevane.functions import lift

    texts = pa.array([None] + [f"{i} " + "x" * 10_000 for i in range(4_000)])
    seen = []
    run = getattr(lift, "in_parts", None) or (lambda f, kind, x: pa.array([None if a is None else f(a) for a in x.to_pylist()], kind))
    tracemalloc.start()
    got = run(lambda t: [t[:5_000], t[5_000:]], pa.list_(pa.string()), texts)
    seen.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert seen[0] < 8e6 and got[0].as_py() is None and [len(x) for x in got[4_000].as_py()] == [5_000, 5_005] and len(got) == 4_001
    assert len(run(len, pa.int32(), texts.slice(0, 0))) == 0
