"""Operators of the document engine, against goldens and round trips."""

import random
import re
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docweave.functions import language as L
from docweave.functions import tables
from docweave.functions import text as X
from docweave.functions.literals import file
from docweave.operators import blocks as B
from docweave.operators import dita as D
from docweave.operators import segments as G
from docweave.operators import terms as N
from docweave.operators import translate as R
from docweave.operators import translators as T
from docweave.operators import validate as V
from docweave.operators.protect import protect_documents, rebuilt
from docweave.plans import metrics as M
from docweave.plans.run import translate_documents

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES = ["---", "title: 标题", "desc: |", "  第一行", "", "  二 `x`", "author: z", "notes: >-", "\tq", "## H  `c`  /usr/<b>/bin", "para CONFIG_A_1 see docs/a.md and /opt/x.bin, https://h/a.html", "- it [l](a.md)", "2. x", "```", "```python", "x = 1  # 说明", "# y", "```c", "int a; // c /* no */", "/* one", "two */ b; /* three */ c", "~~~", ":::note", ":::  ", "| a | b\\|c |", "| --- | --- |", "|  | `z` | - x |", "text <br> <i>t</i>", "　", "   ", "# ", " :::", "[[[", "@@PROTECT_0001@@x"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def torture(spark):
    draw = random.Random(3)
    rows = [(i, "\n".join(draw.choice(LINES) for _ in range(draw.randint(0, 14))) + draw.choice(["", "\n"])) for i in range(400)]
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    odd = [(1000 + i, "".join(draw.choice(LINES) + draw.choice(ends) for _ in range(draw.randint(0, 14))) + draw.choice(["", "x", "```"])) for i in range(400)]
    return spark.createDataFrame([*rows, *odd, (900, None)], "doc_id long, text string").repartition(4)


def test_blocks_of_every_kind(spark):
    text = "---\na: b\n---\n\n# H\np\nq\n- i\n:::tip\nx\n:::\n| a | b |\n|---|---|\n| 1 | 2 |\n```js\n# no\n```"
    got = B.explode_blocks(B.parse_documents(spark.createDataFrame([(1, text)], "doc_id int, text string"))).orderBy("block_index").collect()
    assert [r.block_type for r in got] == ["front_matter", "blank_line", "heading", "paragraph", "list_item", "admonition", "table", "fenced_code_block"]
    assert got[3].raw_text == "p\nq" and got[2].meta == {"level": "1"} and got[5].meta == {"admonition_type": "tip"}


def test_unterminated_blocks_run_to_the_end(spark):
    for text, kind in (("---\na", "front_matter"), ("~~~\n# a", "fenced_code_block"), (":::note\n- a", "admonition")):
        got = B.explode_blocks(B.parse_documents(spark.createDataFrame([(1, text)], "doc_id int, text string"))).collect()
        assert [r.block_type for r in got] == [kind]


def test_protect_numbers_tables_and_front_matter(spark):
    texts = ["| Name | Description |\n| --- | --- |\n| [Docs](guide.md) | Use `boot0` |\n", "---\ntitle: T\ndesc: |\n  a\n\n  b\nauthor: z\nnotes: |\n  k\n---\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.blocks[0] for r in protect_documents(B.parse_documents(docs)).collect()}
    assert got[0].protected_text == "@@PROTECT_0000@@ Name @@PROTECT_0001@@ Description @@PROTECT_0002@@\n@@PROTECT_0003@@\n@@PROTECT_0004@@ [Docs](@@PROTECT_0005@@) @@PROTECT_0006@@ Use @@PROTECT_0007@@ @@PROTECT_0008@@"
    assert got[1].protected_text == "---\n@@PROTECT_0000@@T\n@@PROTECT_0001@@\n@@PROTECT_0002@@a\n@@PROTECT_0003@@\n@@PROTECT_0004@@b\n@@PROTECT_0005@@\n@@PROTECT_0006@@\n@@PROTECT_0007@@\n---"
    assert got[1].translatable


def test_round_trip_is_lossless(torture):
    done = protect_documents(B.parse_documents(torture)).select("text", rebuilt(F.col("blocks"), F.col("trailing_newline")).alias("out"))
    assert done.where("coalesce(text, '') <> out").count() == 0


def test_segments_rebuild_the_document(torture):
    ready = protect_documents(B.parse_documents(torture)).cache()
    segments = G.segment_documents(ready, limit=30)
    assert segments.where("length(text) > 30 and block_type <> 'table' and text not like '%@@PROTECT%'").count() == 0
    same = segments.select("doc_id", "seg_id", F.col("text").alias("translated_text"))
    out = G.rebuild_documents(ready, segments, same).join(torture, "doc_id")
    assert out.where("coalesce(text, '') <> output or missing > 0").count() == 0


def test_file_references():
    found = [m[0] for m in file.finditer("see boot0.bin, ./a/b.md and x.exe or A.PDF.")]
    assert found == ["boot0.bin", "./a/b.md", "A.PDF"]


def test_inline_tokens(spark):
    got = one(spark, B.inline_tokens(F.lit("a [l](t) ![i](p) ``x`y``")))
    assert [(t.type, t.text, t.target) for t in got] == [("text", "a ", ""), ("link", "l", "t"), ("text", " ", ""), ("image", "i", "p"), ("text", " ", ""), ("inline_code", "x`y", "")]


def test_sentences_and_packing(spark):
    assert one(spark, X.sentences(F.lit("A b. C!d 是。不！"))) == ["A b.", " C!d 是。", "不！"]
    assert one(spark, X.pack(X.sentences(F.lit("aaaa. bb. " + "c" * 12 + ". dd.")), 10)) == ["aaaa. bb.", " " + "c" * 9, "ccc.", " dd."]
    assert one(spark, X.pack(F.array(F.lit("x" * 8 + "@@PROTECT_0001@@")), 10)) == ["x" * 8, "@@PROTECT_0001@@"]
    assert one(spark, X.truncated(F.lit("abcdefgh"), 6)) == "abc..."


def test_table_rows_split_only_at_breaks(spark):
    long = "| " + "word " * 10 + "|\n"
    assert one(spark, G.chunked(F.lit("table"), F.lit(long + long), 30)) == [long, long]
    parts = one(spark, G.chunked(F.lit("table"), F.lit("aaa<br>" * 6), 20))
    assert "".join(parts) == "aaa<br>" * 6 and max(map(len, parts)) <= 20


def test_language(spark):
    texts = {"这是一个中文文档示例": "zh", "this text has quite enough english words": "en", "短 one": "mixed_or_unknown", "": "mixed_or_unknown", "`code only words here in ticks` ok": "mixed_or_unknown"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.detect(F.col("t")).alias("d")).collect()
    assert {r.t: r.d.language for r in rows} == texts
    with pytest.raises(ValueError):
        L.direction(F.lit("zh"), "zh_to_fr")


@pytest.mark.parametrize(("loose", "fixed"), [("@@ protect_1 @@", "@@PROTECT_0001@@"), ("\\@\\@PROTECT-0012@@", "@@PROTECT_0012@@"), ("@@PROTECT_12345@@", "@@PROTECT_12345@@"), ("a @@ PROTECT _ 3@@ b", "a @@PROTECT_0003@@ b")])
def test_tokens_are_normalised(spark, loose, fixed):
    assert one(spark, V.normalised(F.lit(loose))) == fixed == R.tidy(loose)


def test_error_codes(spark):
    code = lambda s, t, way, mode=V.Mode(): one(spark, V.error_code(F.lit(s), F.lit(t), F.lit(way), mode))
    assert code("@@PROTECT_0001@@ a @@PROTECT_0002@@", "@@PROTECT_0002@@ a @@PROTECT_0001@@", "zh_to_en") == "placeholders"
    assert code("@@PROTECT_0001@@ a @@PROTECT_0002@@", "@@PROTECT_0002@@ a @@PROTECT_0001@@", "zh_to_en", V.MODES["lenient"]) is None
    assert code("从 @@PROTECT_0001@@ 到 @@PROTECT_0002@@", "@@PROTECT_0002@@ a @@PROTECT_0001@@", "zh_to_en", V.MODES["lenient"]) == "placeholders"
    assert code("x", "中", "zh_to_en") == "residual_zh"
    assert code("x", "one two three four five", "en_to_zh") == "residual_en" and code("x", "one two API three four", "en_to_zh") is None
    assert V.mode("strict") == V.Mode(3, False, 1) and V.mode("strict", residual_threshold=9).residual_threshold == 9


class Scripted(T.MockTranslator):
    """Fails in the ways its name and texts say."""

    def __init__(self, marks=""):
        self.marks = marks

    def translate(self, items, direction, glossary):
        if any("LIMIT" in t for _, t in items) and not self.open():
            raise T.TranslatorError("HTTP 429: Too Many Requests")
        if len(items) > 2:
            raise T.TranslatorError(V.MESSAGES["item_ids"])
        out = super().translate(items, direction, glossary)
        return [(i, re.sub(r"(@@PROTECT_0000@@)(.*)(@@PROTECT_0001@@)", r"\3\2\1", t)) if "swap" in t else (i, t) for i, t in out]

    def open(self):
        import pathlib

        at = pathlib.Path(self.marks)
        if at.exists():
            return True
        at.touch()
        return False


def test_runner_splits_and_rescues():
    runner = R.Runner(Scripted(), R.Policy("zh_to_en", retries=0))
    done = runner.run([(f"s{i}", "词") for i in range(5)] + [("s5", "swap @@PROTECT_0000@@ 中 @@PROTECT_0001@@ 尾")])
    assert list(done) == [f"s{i}" for i in range(6)] and runner.splits == 4 and runner.rescues == 1
    assert done["s5"].index("0000") < done["s5"].index("0001")
    runner = R.Runner(Scripted("/nowhere/at/all"), R.Policy("zh_to_en", retries=1))
    with pytest.raises((T.TranslatorError, OSError)):
        runner.run([("a", "LIMIT")])


def test_rate_limited_batches_run_again(spark, tmp_path):
    mark = str(tmp_path / "open")
    docs = spark.createDataFrame([(1, "中文 LIMIT\n"), (2, "# 标题\n\n段落 `code`\n"), (3, "")], "doc_id long, text string")
    done = translate_documents(docs, "markdown", lambda: Scripted(mark), R.Policy("zh_to_en"), str(tmp_path / "work"))
    assert {r.doc_id: r.output for r in done.outputs.collect()} == {1: "mock LIMIT\n", 2: "# mock\n\nmock `code`\n", 3: ""}
    assert done.translations.agg(F.max("round")).first()[0] == 1 and done.failures.isEmpty()


class Terms(T.MockTranslator):
    """Answers with the entries it was given."""

    def translate(self, items, direction, glossary):
        return [(i, "|".join(sorted(f"{g['source']}={g['target']}" for g in glossary))) for i, _ in items]


def test_a_batch_gets_the_entries_its_texts_hold(spark, tmp_path):
    glossary = spark.createDataFrame([("Boot Loader", "A"), ("loader", "B"), ("启动", "C"), ("启动镜像", "D"), ("absent", "E"), ("boot", "F"), (None, "x"), ("...", "y"), ("loader", "BB")], "source string, target string")
    rows = [(1, "s0", 0, "the boot loader, a LOADER"), (1, "s1", 1, "nothing"), (1, "s2", 2, "启动镜像和启动"), (2, "s0", 0, "boots bootloader boot"), (3, "s0", 0, None)]
    segments = spark.createDataFrame(rows, "doc_id long, seg_id string, ordinal int, text string")
    found = N.term_matches(segments, glossary, ["doc_id", "seg_id"])
    assert {(r.doc_id, r.seg_id, r.source): r.n for r in found.collect()} == {(1, "s0", "Boot Loader"): 1, (1, "s0", "loader"): 1, (1, "s2", "启动镜像"): 1, (1, "s2", "启动"): 1, (2, "s0", "boot"): 1}
    told = []
    done = R.translate_segments(segments.where("text is not null"), Terms, R.Policy("zh_to_en", retries=0), str(tmp_path), batch=1, glossary=glossary, told=lambda turn, c: told.append((turn, c["segments"], c["translated"])))
    assert {(r.doc_id, r.seg_id): r.translated_text for r in done.collect()} == {(1, "s0"): "Boot Loader=A|loader=B", (1, "s1"): "", (1, "s2"): None, (2, "s0"): "boot=F"}
    report = {r.source: (r.texts, r.missed) for r in N.term_report(found, segments.select("doc_id", "seg_id", F.lit("a b c").alias("translated_text")), ["doc_id", "seg_id"]).collect()}
    assert report == {"Boot Loader": (1, 0), "loader": (1, 0), "启动镜像": (1, 1), "启动": (1, 0), "boot": (1, 1)}
    assert told == [(0, 4, told[0][2])]


def test_counters_equal_the_metrics(spark, tmp_path):
    docs = spark.createDataFrame([(1, "中文 LIMIT\n"), (2, "# 标题\n\n段落 `code`\n\n第三\n")], "doc_id long, text string")
    told, at = [], str(tmp_path / "open")
    ready = tmp_path / "p"
    from docweave.plans.run import prepared, translate_prepared

    prepared(docs, "markdown").write.parquet(str(ready))
    done = translate_prepared(spark.read.parquet(str(ready)), "markdown", lambda: Scripted(at), R.Policy("zh_to_en", retries=0), str(tmp_path / "w"), told=lambda turn, c: told.append(c))
    got = M.run_metrics(done.translations).first()
    assert (sum(c["translated"] for c in told), sum(c["splits"] for c in told), sum(c["retries"] for c in told)) == (got.translated, got.split_batches, got.retry_attempts)
    assert told[-1]["waiting"] == 0 and len(told) == got.rate_limit_rounds + 1


def test_a_task_that_runs_again_calls_only_for_the_rest(tmp_path):
    calls = []

    class Counting(T.MockTranslator):
        def translate(self, items, direction, glossary):
            calls.append([i for i, _ in items])
            if len(calls) == 3:
                raise RuntimeError("the executor is lost")
            return super().translate(items, direction, glossary)

    frame = pd.DataFrame({"doc_id": [1, 1, 2, 2], "batch_index": [1, 2, 1, 2], "of": [2, 2, 2, 2], "items": [[{"seg_id": f"s{k}", "text": "词"}] for k in range(4)], "glossary": [[]] * 4})
    task = R._calls(Counting, R.Policy("zh_to_en", retries=0), f"file://{tmp_path}/notes")
    with pytest.raises(RuntimeError):
        list(task(iter([frame])))
    (out,) = task(iter([frame]))
    assert calls == [["s0"], ["s1"], ["s2"], ["s2"], ["s3"]] and out["seg_id"].tolist() == ["s0", "s1", "s2", "s3"] and out["error_code"].isna().all()


def test_a_round_stops_at_the_first_limit_and_says_what_failed(tmp_path):
    class Limit(T.MockTranslator):
        def translate(self, items, direction, glossary):
            if items[0][0] == "s1":
                raise T.TranslatorError("HTTP 429")
            if items[0][0] == "s0":
                raise T.TranslatorError("down")
            return super().translate(items, direction, glossary)

    frame = pd.DataFrame({"doc_id": [1, 1, 1], "batch_index": [1, 2, 3], "of": [3, 3, 3], "items": [[{"seg_id": f"s{k}", "text": "词"}, {"seg_id": "t", "text": "词"}] for k in range(3)], "glossary": [[]] * 3})
    (out,) = R._calls(Limit, R.Policy("zh_to_en", retries=1), f"file://{tmp_path}/notes")(iter([frame]))
    assert out["error_code"].tolist() == ["call", "call", "rate_limit", "rate_limit", "pending", "pending"]
    assert out["message"].tolist()[::2] == ["batch 1 of 3, segments s0, t, attempt 2 of 2: down", "batch 2 of 3, segments s1, t, attempt 1 of 2: HTTP 429", None]


def test_table_functions(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(1, "# H\n\np `c`\n"), (2, None), (3, "")], "id int, text string")
    rows = spark.sql("SELECT id, b.* FROM {docs}, LATERAL md_blocks(text) b ORDER BY id, block_index", docs=docs).collect()
    assert [(r.id, r.block_type, r.raw_text, r.tokens) for r in rows] == [(1, "heading", "# H", 0), (1, "blank_line", "", 0), (1, "paragraph", "p `c`", 1)]
    bad = spark.sql("SELECT * FROM xml_slots('<a') UNION ALL SELECT * FROM xml_slots('<p>x</p>')").collect()
    assert bad[0].error.startswith("parse_document") and (bad[1].tag_name, bad[1].protected_text) == ("p", "x")


def test_cached_segments_are_not_sent(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# 一\n\n二\n")], "doc_id long, text string")
    cached = spark.createDataFrame([(1, "seg-0000", "# One"), (1, "seg-0099", "x")], "doc_id long, seg_id string, translated_text string")
    done = translate_documents(docs, "markdown", T.MockTranslator, R.Policy("zh_to_en"), str(tmp_path), cached=cached)
    assert done.outputs.first().output == "# One\n\nmock\n" and done.translations.count() == 1


def test_http_translator_forms():
    sent = []

    def send(url, headers, body):
        sent.append((url, headers, body))
        text = '```json\n{"items": [{"id": "a", "translated_text": "b"}]}\n```'
        return {"content": [{"type": "text", "text": text}]} if "messages" in url.rsplit("/", 1) else {"choices": [{"message": {"content": text}}]}

    for provider, tail in (("openai_compatible", "/chat/completions"), ("anthropic_compatible", "/messages")):
        made = T.make_translator(provider, T.Endpoint("http://x/v1/", "k", "m"))
        made.send = send
        assert made.translate([("a", "t")], "zh_to_en", []) == [("a", "b")] and sent[-1][0] == f"http://x/v1{tail}"
    with pytest.raises(T.TranslatorError, match="order"):
        T.read_answer('{"items": [{"id": "z", "translated_text": ""}]}', [("a", "t")])
    with pytest.raises(T.TranslatorError, match="api_key"):
        T.HttpTranslator(T.Endpoint("u", " ", "m"))


def test_mock_expression_equals_the_mock(spark):
    texts = ["", "  ", "中文 @@PROTECT_0001@@ abc", "abc-d_e 1", "@@PROTECT_0001@@", "中@@PROTECT_0001@@@@PROTECT_0002@@文"]
    for way in ("zh_to_en", "en_to_zh"):
        want = [t for _, t in T.MockTranslator().translate([("", t) for t in texts], way, [])]
        assert [one(spark, T.mock_translated(F.lit(t), F.lit(way))) for t in texts] == want


def test_dita_slots_and_round_trip(spark):
    text = "<?xml version='1.0'?>\n<!-- c -->\n<topic id='d' xmlns:x='u:x'><title>标题</title><p>请查看<xref href='g.dita'>指南</xref>继续 CONFIG_A_B。</p><codeblock>a</codeblock><p translate='no'>否</p><x:e/></topic>\n<!-- e -->\n"
    docs = spark.createDataFrame([(1, text), (2, "<bad"), (3, None)], "doc_id int, text string")
    rows = {r.doc_id: r for r in D.prepare_documents(docs).select("doc_id", "blocks", "error", D.rebuilt_text(F.col("text"), F.col("blocks")).alias("out")).collect()}
    assert [(b.field_name, b.tag_name, b.protected_text) for b in rows[1].blocks] == [("text", "title", "标题"), ("text", "p", "请查看"), ("text", "xref", "指南"), ("tail", "p", "继续 @@PROTECT_0000@@。")]
    assert rows[1].out.startswith("<?xml version='1.0'?>\n<!-- c -->\n<topic") and rows[1].out.endswith("</topic>\n<!-- e -->\n") and "CONFIG_A_B" in rows[1].out and "x:e" in rows[1].out
    assert rows[2].error.startswith("parse_document") and rows[3].error.startswith("parse_document")
    with pytest.raises(D.ET.ParseError):
        D.parse("<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>")


XML = "<?xml version='1.0' encoding=\"GB2312\"?>\n<!DOCTYPE topic PUBLIC 'a' \"b\">\n<?style a='1'?><!-- c --><x:topic xmlns:x='u:x' xmlns:q=\"u:q\" id = 'd' ><x:title>caf&#233; &amp; 标</x:title>\r\n <x:p a='1'\tb = \"2\">in<!-- no -->after<?pi x?>then<x:ph/>tail &lt;<![CDATA[raw <b> & c]]> end</x:p><codeblock>x &gt; 1</codeblock><x:b></x:b><x:li>é一😀 z</x:li>\n</x:topic>\n<!-- end --> <?z?>\n"


def test_xml_keeps_the_bytes_of_what_is_not_translated():
    found = D.prepare(XML)
    assert [b["protected_text"] for b in found] == ["café & 标", "in", "after", "then", "tail <raw <b> & c end", "é一😀 z"]
    assert D.rebuild(XML, found) == XML
    for k, (old, new) in enumerate([("caf&#233; &amp; 标", "N &amp; &lt;"), ("in<!--", "N &amp; &lt;<!--"), ("after", "N &amp; &lt;"), ("then", "N &amp; &lt;"), ("tail &lt;<![CDATA[raw <b> & c]]> end", "N &amp; &lt;"), ("é一😀 z", "N &amp; &lt;")]):
        given = [{**b, "protected_text": "N & <" if i == k else b["protected_text"]} for i, b in enumerate(found)]
        assert D.rebuild(XML, given) == XML.replace(old, new, 1)
    every = D.rebuild(XML, [{**b, "protected_text": f"{i}\r"} for i, b in enumerate(found)])
    assert [b["protected_text"] for b in D.prepare(every)] == [f"{i}\r" for i in range(6)]


def test_messages(spark):
    said = {"HTTP 429": "rate_limit", "placeholder order": "placeholder_order", V.MESSAGES["residual_en"]: "residual_language", "Connection reset": "network", "HTTP 502": "server", "odd": "failed: odd"}
    assert {m: one(spark, V.retry_reason(F.lit(m))) for m in said} == said
    assert one(spark, M.connection_failure(F.lit("http 401 unauthorized"))) == "authentication" and one(spark, M.connection_failure(F.lit("?"))) == "unknown"
    assert [one(spark, M.elapsed(F.lit(s))) for s in (5.25, 61.0, 3661.0)] in (["5.2s", "01:01", "01:01:01"], ["5.3s", "01:01", "01:01:01"])
    assert one(spark, M.advice(F.lit("glossary"), F.lit(""))) and "429" in one(spark, M.advice(F.lit("x"), F.lit("HTTP 429")))
    assert [one(spark, M.batch_progress(F.lit(k), F.lit(4))) for k in (0, 1, 4)] == [45, 58, 95]
