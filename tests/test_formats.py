from tagloom.plans.corpus import gold, nested
from tagloom.sources import conllu, tei

CONLLU = """# newdoc id = d1
# sent_id = s1
# text = Don't go.
1-2\tDon't\t_\t_\t_\t_\t_\t_\t_\t_
1\tDo\tdo\tAUX\tVBP\tMood=Ind|Number=Sing\t3\taux\t_\t_
2\tn't\tnot\tPART\tRB\t_\t3\tadvmod\t_\tNormalization=not|TokId=w-7
3\tgo\tgo\tVERB\tVB\tVerbForm=Inf\t0\troot\t_\tSpaceAfter=No
3.1\tx\t_\t_\t_\t_\t_\t_\t_\t_
4\t.\t.\tPUNCT\t.\t_\tbad\tpunct\t_\t_

# newdoc id = d2
# sent_id = s2
1\tYes\tyes\tINTJ\tUH\t_\t0\troot\t_\t_
"""


def test_read_conllu(spark):
    files = spark.createDataFrame([("/x/f.conllu", CONLLU)], "file string, value string")
    rows = conllu.read_conllu(files).orderBy("doc_ord", "sent_ord", "tok_ord").collect()
    assert [(r.doc_id, r.form) for r in rows] == [("d1", "Don't"), ("d1", "go"), ("d1", "."), ("d2", "Yes")]
    assert rows[0].is_mwt and [w.form for w in rows[0].subtokens] == ["Do", "n't"]
    assert rows[0].subtokens[1].reg == "not" and rows[0].subtokens[1].tokid == "w-7"
    assert rows[1].space_after is False and rows[2].space_after is None and rows[2].head == 0
    words = conllu.explode_atomic(conllu.read_conllu(files))
    assert sorted(r.form for r in words.collect()) == sorted(["Do", "n't", "go", ".", "Yes"])


def test_backend_ids_are_stripped(spark):
    files = spark.createDataFrame([("/x/f.conllu", CONLLU)], "file string, value string")
    assert {r.doc_id for r in conllu.read_conllu(files, strip_newdoc_ids=True).collect()} == {"f"}


def test_conllu_round_trip(spark, data):
    g = gold(spark, data).filter("doc_id < 5")
    back = conllu.read_conllu(conllu.write_conllu(conllu.nest_sentences(g)).selectExpr("concat(doc_id, '.conllu') AS file", "value"))
    key = lambda df: sorted((r.doc_id, r.form, r.tag) for r in df.collect())
    assert key(g.selectExpr("cast(doc_id AS string) AS doc_id", "form", "tag")) == key(back.selectExpr("doc_id", "form", "upos AS tag"))


def test_tei(spark):
    xml = """<TEI><text id="t"><s id="s1"><name type="PER"><tok id="w1" upos="X" msd="M" nform="ne">a</tok></name> <tok id="w1" form="--">x</tok><tok id="w1">b</tok><tok>c &amp; d</tok></s></text></TEI>"""
    files = spark.createDataFrame([("f.xml", xml), ("bad.xml", "<a>")], "file string, value string")
    rows = tei.read_tei(files).orderBy("tok_ord").collect()
    assert [(r.form, r.tokid, r.space_after) for r in rows] == [("a", "w1", True), ("b", "w1-2", False), ("c & d", None, None)]
    assert rows[0].entity == "PER" and rows[0].xpos == "M" and rows[0].reg == "ne"
    new = tei.writeback(files, spark.createDataFrame([("f.xml", "w1", "NOUN")], "file string, tokid string, value string"))
    assert 'upos="NOUN"' in {r.file: r.value for r in new.collect()}["f.xml"]


def test_detag(spark):
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([(CONLLU,)], "v string").select(F.explode(conllu.detag_lines(F.split("v", "\n"))).alias("x")).collect()
    assert "1\tDo\t_\t_\t_\t_\t_\t_\t_\t_" in [r.x for r in lines]


def test_writers_without_shuffle(spark, data):
    """Arrays of a document's row give what the token table gives, and no exchange is planned."""
    a, b = nested(spark, data).filter("doc_id < 5"), conllu.nest_sentences(gold(spark, data).filter("doc_id < 5"))
    for write in (conllu.write_conllu, tei.write_tei):
        assert sorted(r.value for r in write(a).collect()) == sorted(r.value for r in write(b).collect())
        assert "Exchange" not in write(a)._jdf.queryExecution().executedPlan().toString()


def test_conllu_data_source(spark, tmp_path):
    from tagloom.sources.datasource import ConlluSource

    spark.dataSource.register(ConlluSource)
    docs = spark.createDataFrame([(1, CONLLU), (2, "# newdoc id = z\n1\tA\t_\t_\t_\t_\t_\t_\t_\t_\n\n")], "doc_id long, value string")
    docs.write.format("conllu").mode("append").save(str(tmp_path / "c"))
    rows = spark.read.format("conllu").load(str(tmp_path / "c")).collect()
    assert {(r.doc_id, r.sent_ord, r.id, r.form) for r in rows} >= {("d1", 0, "1-2", "Don't"), ("d1", 0, "3.1", "x"), ("d2", 0, "1", "Yes"), ("z", 0, "1", "A")}
    assert all(r.lemma is None for r in rows if r.form == "A")


def test_project_documents(spark, tmp_path):
    import datetime

    from tagloom.sources import project as PR

    xml = '<ttsettings><defaults lang="spa"/><cqp><pattributes><item key="pos" display="POS"/></pattributes></cqp><tool><item lang="spa" backend="x" model="m"/></tool></ttsettings>'
    assert PR.read_project_settings(xml) == {"language": "spa", "attributes": {"pos": "POS"}, "backends": {"spa": ("x", "m")}}
    assert PR.read_project_settings("<a>")["language"] is None
    (tmp_path / "r.json").write_text('{"backends": {"A": {"models": [{"model": "m1", "language_iso": "es", "url": "u"}]}, "B": {"models": []}}}')
    assert [tuple(r) for r in PR.read_registry(spark, str(tmp_path / "r.json"), "a").collect()] == [("A", "m1", "es", "u")]
    (tmp_path / "e.json").write_text('{"EN": {"text": "a b"}, "fr": {}}')
    assert [tuple(r) for r in PR.read_examples(spark, str(tmp_path / "e.json")).collect()] == [("en", "a b")]
    model = '{"vocab": {"go": [{"upos": "VERB", "count": 3}, {"upos": "NOUN"}], "a": {"upos": "DET", "lemma": "a", "count": 2}}, "transitions": {"upos": {"DET": {"NOUN": 4}}, "start": {"DET": 5}}, "settings": {"beam": 3}}'
    t = PR.read_model(spark.createDataFrame([(model,)], "value string"))
    assert {(r.form, r.tag, r.n) for r in t["lexicon"].collect()} == {("go", "VERB", 3), ("go", "NOUN", 1), ("a", "DET", 2)}
    assert [(r.attribute, r.prev, r.next, r.n) for r in t["transitions"].collect()] == [("upos", "DET", "NOUN", 4)]
    assert [tuple(r) for r in t["starts"].collect()] == [("DET", 5)] and [tuple(r) for r in t["settings"].collect()] == [("beam", "3")]
    assert PR.parse_tasks("pos, lemma") == {"tag", "lemmatize"} and PR.parse_tasks("") == set(PR.DEFAULT_TASKS)
    assert PR.required_annotations("native", "x") == ["xpos", "lemma"]
    out = PR.augment_header("<TEI><text>a</text></TEI>", "n", "c", "2020")
    assert "<note>n</note>" in out and '<change when="2020">c</change>' in out and PR.augment_header("<a") == "<a"
    assert PR.pretty_print_xml('<TEI><text><s><tok>a</tok> <tok>b</tok></s><s/></text></TEI>').count("\n") == 5
    f = tmp_path / "x.xml"
    f.write_text("a")
    assert PR.daily_backup(str(f), datetime.date(2020, 1, 2)).endswith("backups/x-20200102.xml") and PR.daily_backup(str(f), datetime.date(2020, 1, 2)) is None


def test_text_rules(spark):
    from tagloom.functions import text as T

    one = lambda f, x: spark.createDataFrame([(x,)], "v string").select(f("v")).first()[0]
    for word, case in {"McDonaldS": "UU", "A1": "Ul", "ABC": "UU", "A": "Ul", "a": "ll", "1": "??", "": "ll", "Éa": "Ul"}.items():
        assert one(T.form_case, word) == case, word
    for raw, key in {"Field2": "Field2", "text(88)": "text", "field-name": "field_name", "transl_ru-13": "transl_ru", "###a[b": "a", "é": None, "__x..y_": "x_y", "": None}.items():
        assert one(T.clean_misc_key, raw) == key, raw


def test_tei_documents_are_what_the_writer_makes(spark, data, tmp_path):
    from tagloom.plans import corpus

    odd = "ǅabc 12 ½ ²³ Éa É. it's _ -- a'b İI ΑΣ «x» 中文 é a\"b <t> & ٣٤ é _", " \n", None, "Ça va? Ñandú! x.y A1 1A ß Ⅷ ª"
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (data, str(tmp_path)):
        want = {r.doc_id: r.value for r in tei.write_tei(corpus.nested(spark, d)).collect()}
        assert want == {r.doc_id: r.value for r in corpus.tei_documents(corpus.read(spark, d, "documents")).collect()}


def test_tei_is_parsed_without_a_tree():
    """Tails, not leading text, part tokens; comments don't; markup in a token is its text."""
    xml = '<TEI><text id="d"><s id="a"><tok id="x">I<hi>t</hi><dtok form="q"/></tok><!-- c --> <hi> <tok id="x">b</tok></hi>, <tok form="--"/><name><tok head="y">c</tok></name> </s><tok>d</tok></text></TEI>'
    rows = [(r[1], r[2], r[4], r[5], r[6], r[15], r[16], r[17]) for r in tei.parse("/x/f.xml", xml)]
    assert rows == [("d", 0, 0, "x", "It", True, None, 1), ("d", 0, 1, "x-2", "b", False, None, 0), ("d", 0, 2, None, "c", True, "name", 0), ("d", 0, 3, None, "d", None, None, 0)]
    deep = "<TEI>" + "<p>" * 5000 + "<tok>a</tok>" + "</p>" * 5000 + "</TEI>"
    assert [r[6] for r in tei.parse("/x/f.xml", deep)] == ["a"] and tei.parse("/x/f.xml", "<a><tok>b</tok>") == []


def test_plain_tei_is_scanned_as_it_is_parsed(spark, data):
    """Whole documents at once give the rows of the parser; whatever is not plain is left to it."""
    from tagloom.plans import corpus

    docs = [r.value.encode() for r in corpus.tei_documents(corpus.read(spark, data, "documents")).collect()]
    odd = '<TEI><text id="a&amp;b">\n<s id="s-1"><tok id="w" upos="--" msd="" pos="P" reg="&lt;&amp;lt;" head="12" deprel="_">é&gt;</tok> <tok id="w2"></tok><tok id="w3" lemma="--" nform="n"> </tok></s>\n<s id=""></s><s id="z"><tok id="q">x</tok> </s></text></TEI>'
    docs = [d for d in docs if b">--<" not in d] + [odd.encode()]
    for wanted in (None, ("doc_id", "tok_ord", "form", "space_after")):
        starts = [sum(len(x) for x in docs[:i]) for i in range(len(docs))]
        found, of = tei.scan(b"".join(docs), starts, wanted=wanted)
        names = [c for c, _ in tei._COLUMNS if c in found]
        want = [r for d in docs for r in tei.parse("f", d.decode())]
        assert len(names) == (17 if wanted is None else 4) and len(of) == len(want) > 100
        places = [[c for c, _ in tei._COLUMNS].index(c) for c in names]
        assert list(zip(*(found[c].to_pylist() for c in names))) == [tuple(r[k] for k in places) for r in want]
    # Others: forbidden, or allowed but not plain.
    tok = lambda x: f'<TEI><text id="t"><s id="s">{x}</s></text></TEI>'
    changed = [
        "", "<TEI>", odd[:-1], odd + " ", odd.replace("é", "\x01"), odd.replace("é", "&eacute;"), odd.replace("é", "&#233;"), odd.replace("é", "￾"), odd.replace("é", "]]>"), odd.replace("é", "<hi>a</hi>"), odd.replace("é", "<!-- -->"), odd.replace("é", '"'), odd.replace("é", " "),
        tok('<tok id="a" upos="x" upos="y">b</tok>'), tok('<tok id="a" other="x">b</tok>'), tok('<tok id="a"  upos="x">b</tok>'), tok("<tok id='a'>b</tok>"), tok('<tok id="a">--</tok>'), tok('<tok id="a">b</tok>,<tok id="c">d</tok>'), tok('<tok id="a"/>'), tok('<tok id="a" upos="<">b</tok>'),
        tok('<tok id="a">b</tok></tok>'), tok('<tok id="a"><tok id="b">c</tok></tok>'), tok('<tok id="a" form="x">b</tok>'), tok('<tok id="a" head="x">b</tok>'), tok('<tok id="a">b</tok><tok id="a">b</tok>'), tok('<tok id="a" >b</tok>'), tok('<tok id="a">b</tok>').replace("<s ", "<p><s "),
    ]
    assert [x for x in changed if x and tei.scan(x.encode(), [0]) is not None] == []
    files = spark.createDataFrame([(f"/x/{i}.xml", x) for i, x in enumerate([*changed, odd])], "file string, value string")
    rows = sorted(map(repr, map(tuple, tei.read_tei(files).collect())))
    assert rows == sorted(repr(r) for i, x in enumerate([*changed, odd]) for r in tei.parse(f"/x/{i}.xml", x)) and len(rows) > 10


def test_teitok_queries_equal_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from tagloom.plans import load

    odd = 'A b   c. «x» "q" <t> & \'s. É!', " \n", None, "", ".", "Ça va? 12 ½ a&amp;b ]]> 中文. . x", "  lead. trail  "
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").selectExpr("*", "'l' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("read_teitok_mapped", "read_teitok_native"):
        got = load()[0][name](spark, str(tmp_path)).toDF(*[c for c in ("doc_id", "sent_ord", "tok_ord", "form", "upos", "xpos", "reg", "space_after")])
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, duck.execute(load()[1][name]).fetchall()))
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
